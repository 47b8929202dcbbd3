"""Audit, enrichment roll-ups, the user feature table, vectors and hour-of-day profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.functions import vectors as V


def user_audit(users: DataFrame, tweets: DataFrame, follows: DataFrame, flags: dict[str, Column], least_text: int = 8, least_time: int = 8, least_behaviour: int = 1) -> DataFrame:
    """Per user: tweets, conditional tweet counts, degrees, and which analyses are possible. Authors that users lacks are added.

    tweets (user_id, ...) with a condition per counter; the counters `text` and `dated` decide the flags. follows: (source, target).
    """
    counted = tweets.groupBy("user_id").agg(F.count(F.lit(1)).alias("tweets"), *[F.count_if(c).alias(f"tweets_{k}") for k, c in flags.items()])
    degree = follows.select(F.col("source").alias("user_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(follows.select(F.col("target").alias("user_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = degree.groupBy("user_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    rows = users.withColumn("in_users", F.lit(True)).join(counted, "user_id", "full").join(degree, "user_id", "left")
    numbers = ["tweets", *[f"tweets_{k}" for k in flags], "out_degree", "in_degree"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in numbers}).withColumn("in_users", F.coalesce("in_users", F.lit(False)))
    return rows.withColumns(
        {
            "can_text": (F.col("tweets_text") >= least_text).cast("int"), "can_time": (F.col("tweets_dated") >= least_time).cast("int"),
            "can_behaviour": (F.col("tweets") >= least_behaviour).cast("int"), "can_network": (F.col("out_degree") + F.col("in_degree") > 0).cast("int"),
        }
    )


def audit_summary(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and rates of an audit, overall or per key."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("users"), F.sum("tweets").alias("tweets"), F.round(F.avg("tweets"), 4).alias("average_tweets"), *[rate(c) for c in ("can_text", "can_time", "can_behaviour", "can_network")])


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def type_distribution(tweets: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """Per user: a count and a ratio for each of a fixed set of types, 0 where there is none."""
    counts = tweets.groupBy("user_id").agg(F.count(F.lit(1)).alias("tweets"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])
    return counts.withColumns({f"ratio_{k}": F.col(f"n_{k}") / F.greatest(F.col("tweets"), F.lit(1)) for k in kinds})


def user_documents(parts: DataFrame, order: str, text: str, by: str = "user_id") -> DataFrame:
    """Per user: the number of parts and their texts in order, joined by newlines. An order is needed as Spark's rows have none."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(pairs, lambda x: x["t"]), "\n").alias("document"))


def triplet_documents(triplets: DataFrame) -> DataFrame:
    """Per user: tweets, triplets, tweet ids and the document of triplet_text, from rows (user_id, tweet_id, ord, triplets, triplet_text)."""
    ids = F.array_sort(F.collect_list(F.struct("ord", "tweet_id")))
    texts = F.array_sort(F.collect_list(F.struct("ord", "triplet_text")))
    return triplets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("tweet_count"), F.sum(F.size("triplets")).alias("triplet_count"), F.transform(ids, lambda x: x["tweet_id"]).alias("tweet_ids"),
        F.array_join(F.transform(texts, lambda x: x["triplet_text"]), "\n").alias("triplet_document"),
    )


def hour_histogram(tweets: DataFrame, ts: str = "ts", least: int = 8) -> DataFrame:
    """Per user: 24 counts by UTC hour, whatever the session's zone, their distribution, and whether there are at least max(least, 1) dated tweets."""
    dated = tweets.where(F.col(ts).isNotNull())
    counts = dated.groupBy("user_id").agg(F.count(F.lit(1)).alias("dated"), F.array(*[F.count_if(N.utc_hour(tweets, ts) == h) for h in range(24)]).alias("hours"))
    return counts.withColumn("distribution", F.transform("hours", lambda x: x / F.col("dated"))).withColumn("ready", (F.col("dated") >= max(least, 1)).cast("int"))


def tweet_authors(tweets: DataFrame, posts: DataFrame) -> DataFrame:
    """Tweets with the user that posted them, by post edges (user_id, tweet_id, ord); of several the last."""
    author = posts.groupBy("tweet_id").agg(F.max_by("user_id", "ord").alias("user_id"))
    return tweets.drop("user_id").join(author, "tweet_id")


def resolution(expected: DataFrame, done: DataFrame, errors: DataFrame) -> DataFrame:
    """Per user: expected tasks, resolved ones, and distinct errors that no success makes good. Each table: (user_id, tweet_id)."""
    n = lambda df, name: df.groupBy("user_id").agg(F.count_distinct("tweet_id").alias(name))
    open_ = errors.join(done.select("tweet_id").distinct(), "tweet_id", "left_anti")
    good = expected.join(done.select("tweet_id").distinct(), "tweet_id", "left_semi")
    out = n(expected, "expected").join(n(good, "resolved"), "user_id", "full").join(n(open_, "unresolved"), "user_id", "full")
    out = out.na.fill(0, ["expected", "resolved", "unresolved"])
    return out.withColumn("incomplete", ((F.col("resolved") < F.col("expected")) | (F.col("unresolved") > 0)).cast("int"))


def feature_table(users: DataFrame, *tables: DataFrame, key: str = "user_id") -> DataFrame:
    """users with the columns of further per-user tables, left-joined; numbers that are missing are 0."""
    out = users
    for t in tables:
        new = [c for c in t.columns if c != key and c not in out.columns]
        out = out.join(t.select(key, *new), key, "left")
        numeric = [c for c, kind in t.select(*new).dtypes if kind in ("int", "bigint", "double", "float", "smallint")]
        out = out.na.fill(0, numeric)
    return out


def zscores(rows: DataFrame, columns: Sequence[str], fit: Column | None = None, floor: float = 1e-9, flat: str = "one") -> DataFrame:
    """rows with `z`, the columns' z-scores by population deviation.

    fit: rows the statistics come from (all without it). A deviation at most `floor` counts as 1 (flat="one") or gives 0 (flat="zero").
    """
    base = rows if fit is None else rows.where(fit)
    stats = base.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    sd = lambda c: F.coalesce(F.col(f"_s_{c}"), F.lit(0.0))
    shift = lambda c: F.col(c) - F.coalesce(F.col(f"_m_{c}"), F.lit(0.0))
    scaled = lambda c: F.when(sd(c) > floor, shift(c) / sd(c)).otherwise(shift(c) if flat == "one" else F.lit(0.0))
    return rows.join(F.broadcast(stats)).withColumn("z", F.array(*[scaled(c) for c in columns])).drop(*stats.columns)


def behaviour_vectors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores over all users, then unit length."""
    return zscores(rows, columns).withColumn("behaviour", V.normalized("z"))


def network_vectors(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: log1p of in and out degree, duplicates counted, as a vector and a unit vector; and the distinct neighbours on either side."""
    both = follows.select(F.col("source").alias("user_id"), F.col("target").alias("other"), F.lit(1).alias("o")).unionByName(follows.select(F.col("target").alias("user_id"), F.col("source").alias("other"), F.lit(0).alias("o")))
    stats = both.groupBy("user_id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.collect_set(F.when(F.col("o") == 1, F.col("other"))).alias("followed"), F.collect_set(F.when(F.col("o") == 0, F.col("other"))).alias("following_it"))
    rows = users.join(stats, "user_id", "left").na.fill(0, ["out_degree", "in_degree"])
    vector = F.array(N.log1p_count("in_degree"), N.log1p_count("out_degree"))
    return rows.withColumn("degrees", vector).withColumn("degrees_unit", V.normalized("degrees"))


def fused_vectors(embeddings: DataFrame, numeric: DataFrame, size: int) -> DataFrame:
    """Per user: the embedding padded to `size` (zeros if there is none) and the numeric vector, as one."""
    rows = numeric.join(embeddings, "user_id", "left")
    return rows.select("user_id", V.fused("embedding", "z", size).alias("fused"))
