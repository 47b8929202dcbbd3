"""Secret scans: the models' ratio, keys without an assignment, names, overlaps and long texts."""

import math
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from murmur.llm import base, secrets
from tests.conftest import DATA
from tests.llm import common
from tests.llm.test_operators import SECRETS, plain_secrets

LETTERS = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(base.table(spark, f"{DATA}/sf0.01", "documents"), base.table(spark, f"{DATA}/sf0.01", "labels"))


def plain_ratio(token, model):
    n = len(secrets.ALPHABET)
    at = [secrets.ALPHABET.index(c) for c in token]
    return sum(model[a * n + b] for a, b in zip(at, at[1:], strict=False)) / (len(token) - 1)


def plain_model(rows):
    """The log-ratios from lists of (token, random) in plain Python."""
    n = len(secrets.ALPHABET)
    count = [[[0] * n for _ in range(n)] for _ in range(2)]
    for token, kind in rows:
        at = [secrets.ALPHABET.find(c) for c in token]
        for a, b in zip(at, at[1:], strict=False):
            if a >= 0 and b >= 0:
                count[kind][a][b] += 1
    alone = [[sum(count[k][a][b] for a in range(n)) for b in range(n)] for k in (0, 1)]
    alone = [[(x + secrets.SMOOTH) / (sum(row) + secrets.SMOOTH * n) for x in row] for row in alone]
    log = lambda k, a, b: math.log((count[k][a][b] + secrets.WEIGHT * alone[k][b]) / (sum(count[k][a]) + secrets.WEIGHT))
    return [log(1, a, b) - log(0, a, b) for a in range(n) for b in range(n)]


def planted(seed, n):
    """Keys of four kinds, and words that people write, each among ordinary words and without an assignment."""
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        kind, size = i % 8, rng.randrange(24, 48)
        key = [
            "".join(rng.choices(LETTERS, k=size)), "".join(rng.choices(string.ascii_uppercase + string.digits, k=size)), "".join(rng.choices(LETTERS + "+/", k=size)), "".join(rng.choices("0123456789abcdef", k=28)),
            "".join(rng.choices("the of and under stand over write read house water light".split(), k=6)), "/".join(rng.choices("home user project source public index".split(), k=5)),
            "-".join(rng.choices("long running story about north wind".split(), k=6)), "_".join(rng.choices("count total number value result".split(), k=5)),
        ][kind]
        texts.append(f"{common.sentence(rng, 9)} {key} {common.sentence(rng, 9)}")
        marks.append(kind < 4)
    return texts, marks


def test_model_equals_a_plain_one(spark):
    docs, labels = common.documents(spark), common.labels(spark, 20)
    rows = secrets.samples(docs, labels)
    want = plain_model([(r.token, int(r.random)) for r in rows.collect()])
    assert secrets.train(rows) == pytest.approx(want, abs=1e-9)


def test_ratio_equals_a_plain_one(spark, model):
    rng = random.Random(2)
    tokens = ["".join(rng.choices(secrets.ALPHABET, k=rng.choice([2, 3, 20, 40, secrets.PIECE, secrets.PIECE + 1, secrets.PIECE + 2, 3 * secrets.PIECE]))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.mean_ratio(F.col("t"), model).alias("r")).collect()
    assert all(r.r == pytest.approx(plain_ratio(r.t, model), abs=1e-9) for r in got)


def test_every_candidate_is_judged(spark, model):
    texts = [t for t in common.odd_texts() if t and len(t) < 50_000] + SECRETS + planted(3, 40)[0]
    rows = secrets.scan(common.documents(spark, texts), model).collect()
    for r in rows:
        spans = [(s, k, e) for s, k, e in plain_secrets(r.text)]
        for m in re.finditer(secrets.CANDIDATE, r.text):
            if not any(a < m.end() and m.start() < b for a, _, b in spans) and plain_ratio(m[0], model) >= secrets.THRESHOLD:
                spans.append((m.start(), 3, m.end()))
        assert [tuple(x) for x in r.spans] == sorted(spans)


def test_planted_keys_without_assignment(spark, model):
    texts, marks = planted(4, 400)
    rows = {r.doc_id: r.spans for r in secrets.scan(common.documents(spark, texts), model).collect()}
    found = [bool(rows[i]) for i in range(len(texts))]
    hits = sum(f and m for f, m in zip(found, marks, strict=True))
    assert hits / sum(marks) >= 0.95 and hits / sum(found) >= 0.95


def test_helper_names_never_clash(spark, model):
    docs = common.documents(spark, [*SECRETS, None, ""])
    names = ["_text", "_runs", "_base", "_spans", "base", "spans", "token", "_TEXT2"]
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = secrets.redact(wide, model)
    assert out.columns == wide.columns and all(r[n] == f"own {n}" for r in out.collect() for n in names)
    plain = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert {r.doc_id: r.text for r in out.collect()} == plain
    spans = {r.doc_id: r.spans for r in secrets.scan(wide, model).collect()}
    assert spans == {r.doc_id: r.spans for r in secrets.scan(docs, model).collect()}
    assert {r.doc_id: r.spans for r in secrets.report(wide, model).collect()} == {r.doc_id: r.spans for r in secrets.report(docs, model).collect()}


def test_masks_of_many_overlapping_spans(spark, model):
    rng = random.Random(5)
    parts = ["password=" + "a1" * 20, "AKIA" + "B" * 14, "0" * 40, "é", "﻿", "🙂", " ", " token=" + "f" * 40, "x", "secret='AKIAAKIAAKIAAKIA'"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 2500))) for _ in range(8)] + ["﻿" + "0" * 40 + "﻿﻿"]
    docs = common.documents(spark, texts)
    got = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    for r in secrets.scan(docs, model).collect():
        out, at = "", 0
        assert [(s, k, e) for s, k, e in r.spans if k < 3] == plain_secrets(r.text)
        for s, _, e in r.spans:
            if s >= at:
                out += r.text[at:s] + "[secret]"
            at = max(at, e)
        assert got[r.doc_id] == out + r.text[at:], r.doc_id


@pytest.mark.parametrize("make", [lambda n, rng: "".join(rng.choices(LETTERS, k=n)), lambda n, rng: " ".join("token=" + "".join(rng.choices(LETTERS, k=12)) + " " + "".join(rng.choices(LETTERS, k=24)) for _ in range(n // 44))])
def test_time_grows_with_the_text(spark, model, make):
    rng, took = random.Random(6), {}
    for n in (10_000, 1_000_000, 4_000_000):
        df = common.documents(spark, [make(n, rng)])
        start = time.perf_counter()
        assert secrets.redact(df, model).select("text").collect() and secrets.report(df, model).collect()[0].spans
        took[n] = time.perf_counter() - start
    assert took[4_000_000] < 1.5 * 4 * took[1_000_000]
