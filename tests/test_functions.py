import hashlib
import math

import pytest
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_hexdigest_equals_hashlib(spark):
    assert one(spark, N.stable_hexdigest(42, F.lit("a"), F.lit("b"))) == hashlib.sha1(b"42|a|b").hexdigest()


@pytest.mark.parametrize(("x", "want"), [(None, 0), ("", 0), ("x", 0), ("1,234", 1234), ("3.9", 3), ("-2.5", -2), ("true", 1), ("nan", 0), ("Infinity", 0), (" 7 ", 7)])
def test_to_int(spark, x, want):
    assert one(spark, N.to_int(lit(x))) == want


@pytest.mark.parametrize(("x", "want"), [("12", "u12"), ("U12", "u12"), ("u12", "u12"), ("abc", "abc"), (" 5 ", "u5")])
def test_canonical_user_id(spark, x, want):
    assert one(spark, N.canonical_user_id(F.lit(x))) == want


def test_enums(spark):
    for f, cases in ((N.label, {"Bot": "bot", "0": "human", None: "missing", "odd": "odd"}), (N.split, {"dev": "valid", "Train": "train", "": "missing"}), (N.verified_bucket, {"YES": "true", "0": "false", "?": "missing", None: "missing"})):
        for x, want in cases.items():
            assert one(spark, f(lit(x))) == want


@pytest.mark.parametrize("x", ["2020-02-03T04:05:06Z", "2020-02-03 04:05:06", "Mon, 3 Feb 2020 04:05:06 +0000", "Mon Feb 03 04:05:06 +0000 2020"])
def test_timestamps(spark, x):
    assert one(spark, F.unix_seconds(N.parse_timestamp(F.lit(x)))) == 1580702706
    assert one(spark, N.parse_timestamp(F.lit("soon"))) is None


def test_percentile_and_buckets(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x long")
    assert rows.select(N.percentile("x", 0.5).alias("p")).first().p == 2  # 2.5, halves to even
    edges = rows.select(N.quantile_edges("x").alias("e")).first().e
    assert edges == [2, 2, 5]  # 1.75, 2.5, 4.75
    e = F.array(*[F.lit(x) for x in edges])
    assert [one(spark, N.bucket(F.lit(x).cast("long"), e)) for x in (2, 3, 6, None)] == ["q1", "q3", "q4", "missing"]


@pytest.mark.parametrize(("n", "limit", "want"), [(3, 2, [0, 2]), (5, 3, [0, 2, 4]), (4, 3, [0, 2, 3]), (2, 5, [0, 1]), (0, 3, []), (9, 1, [0]), (9, 0, [])])
def test_even_indices(spark, n, limit, want):
    assert one(spark, N.even_indices(F.lit(n), limit)) == want


@pytest.mark.parametrize(("x", "want"), [(0.25, "0p25"), (-1.5, "neg1p5"), (3.0, "3"), (0.0, "0")])
def test_slugify(spark, x, want):
    assert one(spark, N.slugify_float(F.lit(x))) == want


def test_external_urls(spark):
    entry = lambda u: F.array(F.struct(F.lit(u).alias("expanded_url"), F.lit("").alias("display_url"), F.lit("").alias("url")))
    for url, want in (("https://t.co/x", False), ("https://X.com/a", False), ("example.org/a", True), ("https://a.example.org", True), ("", False)):
        assert one(spark, N.has_external_url(entry(url))) is want


def test_post_types(spark):
    none = F.array().cast("array<struct<id:string,type:string>>")
    refs = lambda t: F.array(F.struct(F.lit("1").alias("id"), F.lit(t).alias("type")))
    url = F.array(F.struct(F.lit("https://e.org").alias("expanded_url"), F.lit("").alias("display_url"), F.lit("").alias("url")))
    cases = [("RT @a: b", none, ("retweet", "retweet", 0.99)), ("a", refs("retweeted"), ("retweet", "retweet", 0.99)), ("a", refs("replied_to"), ("comment_reply", "reply", 0.99)), ("a", refs("quoted"), ("comment_reply", "quote_comment", 0.95)), ("a", none, ("link_share", "link_share", 0.9))]
    for text, r, want in cases:
        assert tuple(one(spark, N.post_type(F.lit(text), r, url))) == want
    assert tuple(one(spark, N.post_type(F.lit("a"), none, F.slice(url, 1, 0)))) == (None, None, None)


def array(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    assert one(spark, V.cosine(array(1, 0), array(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, V.cosine(array(0, 0), array(1, 1))) is None
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.cosine(array(1), array(1, 1)))
    assert one(spark, V.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, V.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) is None
    assert one(spark, V.js_similarity(array(1, 2, 3), array(2, 4, 6))) == pytest.approx(1)
    assert one(spark, V.js_similarity(array(1, 0), array(0, 1))) == pytest.approx(0)
    assert one(spark, V.js_similarity(array(0, 0), array(0, 1))) is None


def test_fusion_leaves_missing_channels_out(spark):
    null = F.lit(None).cast("double")
    value, mass = V.weighted_available([(F.lit(0.8), 0.25), (F.lit(0.6), 0.25), (null, 0.25), (null, 0.25)])
    assert one(spark, value) == pytest.approx(0.7)
    assert one(spark, mass) == pytest.approx(0.5)
    assert one(spark, V.weighted_available([(null, 1.0)])[0]) is None


def test_warping(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0], [0.0, 1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([0.0, 1.0, 0.0], [0.0, 0.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in rows.select(V.dtw_average_distance("a", "b").alias("x")).collect()]
    assert got[0] == 0 and got[1] == 1 and got[2] is None and got[3] == pytest.approx(1 / 4)
    back = [r.x for r in rows.select(V.dtw_average_distance("b", "a").alias("x")).collect()]
    assert [got[k] for k in (0, 1)] == [back[k] for k in (0, 1)]
