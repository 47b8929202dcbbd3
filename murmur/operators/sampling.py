"""Deterministic quotas, strata, seeds, context, tweet selection, closure and validation.

Every "random" order is a SHA-1 of the seed and the row's keys, so results do not depend on partitioning. Ranks are window functions
partitioned by the entity that is ranked; with a bound on the rank Spark keeps only the top rows of each partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import normalize as N

PRESETS = {"smoke": 2_000, "main": 10_000}
TWEET_BUDGETS = {"smoke": 40_000, "main": 250_000}
POOLS = (("primary", 0.85), ("sparse", 0.15))
CONTEXT_LIMITS = {"mutual": 10, "follower": 5, "following": 5}
SEED_TWEETS, CONTEXT_TWEETS, PREFILTER = 20, 8, 5
MAX_SPLIT_DELTA = MAX_LABEL_DELTA = 0.015


def largest_remainder(groups: DataFrame, key: str, weight: str, total: int | Column, by: Sequence[str] = (), name: str = "quota") -> DataFrame:
    """groups with whole quotas that sum to `total` (per `by`): floors of the shares, what is left to the largest fractions, ties by key.

    groups is an aggregate: one row per key. Negative weights count as 0; where all are 0 every quota is 0. A total below 0 is 0.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(0))
    rows = groups.withColumn("_w", F.greatest(F.col(weight).cast("double"), F.lit(0.0))).withColumn("_all", F.sum("_w").over(w))
    rows = rows.withColumn("_raw", F.when(F.col("_all") > 0, total * (F.col("_w") / F.col("_all"))).otherwise(0.0)).withColumn("_floor", F.floor("_raw"))
    rows = rows.withColumn("_left", F.when(F.col("_all") > 0, total - F.sum("_floor").over(w)).otherwise(0))
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy((F.col("_raw") - F.col("_floor")).desc(), F.col(key).cast("string"))))
    return rows.withColumn(name, F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).drop("_w", "_all", "_raw", "_floor", "_left", "_rank")


def with_strata(rows: DataFrame, columns: Sequence[str], extra: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """rows with `stratum`: the quartile of each column (ties together; quartiles per `by`) and further columns, joined by |."""
    edges = rows.groupBy(*by).agg(*[N.quantile_edges(c).alias(f"_e_{c}") for c in columns])
    joined = rows.join(edges, list(by)) if by else rows.join(F.broadcast(edges))  # one row without `by`
    parts = [N.bucket(c, F.col(f"_e_{c}")) for c in columns] + [F.coalesce(F.col(c), F.lit("missing")) for c in extra]
    return joined.withColumn("stratum", F.concat_ws("|", *parts)).drop(*[f"_e_{c}" for c in columns])


def stratified_pick(rows: DataFrame, target: int | Column, seed: int, namespace: str | Column, by: Sequence[str] = (), stratum: str = "stratum", key: str = "user_id") -> DataFrame:
    """At most `target` rows (per `by`): quotas of the strata by largest remainder, rows of a stratum in hash order; what is short is filled from the rest in hash order."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    rows = rows.withColumn("_target", F.lit(target) if isinstance(target, int) else target)
    sizes = rows.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("_n"), F.first("_target").alias("_target"))
    quotas = largest_remainder(sizes, stratum, "_n", F.col("_target"), by, "_quota").select(*by, stratum, "_quota")
    ranked = rows.join(quotas, [*by, stratum])
    order = Window.partitionBy(*by, stratum).orderBy(N.stable_hexdigest(seed, ns, stratum, key), key)
    ranked = ranked.withColumn("_first", F.row_number().over(order) <= F.col("_quota"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    fill = whole.orderBy((~F.col("_first")).cast("int"), F.when(~F.col("_first"), N.stable_hexdigest(seed, ns, F.lit("remainder"), key)), key)
    return ranked.withColumn("_place", F.row_number().over(fill)).where("_place <= _target").drop("_target", "_quota", "_first", "_place")


def select_seeds(profile: DataFrame, size: int | str, seed: int = 42) -> DataFrame:
    """Seed users: quotas by split, then by label, then 85 / 15 by pool; strata within pools; deficits filled in hash order.

    profile has user_id, split, label, verified_bucket, followers_count, following_count, tweet_count_hint, primary_pool and sparse_pool
    (booleans). Rows with a missing split or label never are seeds. Returns the profile rows, with `seed_order`.
    """
    size = PRESETS[size] if isinstance(size, str) else size
    rows = profile.where("split <> 'missing' and label <> 'missing'")
    splits = largest_remainder(rows.groupBy("split").agg(F.count(F.lit(1)).alias("_n")), "split", "_n", size, name="_split_quota").drop("_n")
    cells = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("_n")).join(splits, "split")
    cells = largest_remainder(cells, "label", "_n", F.col("_split_quota"), ["split"], "_target").select("split", "label", "_target")
    pools = cells.select("split", "label", F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in POOLS]), F.array(*[F.lit(w) for _, w in POOLS]))).alias("pool", "_w"), "_target")
    pools = largest_remainder(pools, "pool", "_w", F.col("_target"), ["split", "label"], "_pool_target").select("split", "label", "pool", "_pool_target")
    cell = ["split", "label"]
    strata = with_strata(rows, ["tweet_count_hint", "followers_count", "following_count"], ["verified_bucket"], cell)
    in_pool = strata.withColumn("pool", F.explode(F.array_compact(F.array(F.when(F.col("primary_pool").cast("boolean"), "primary"), F.when(F.col("sparse_pool").cast("boolean"), "sparse")))))
    in_pool = in_pool.join(pools, [*cell, "pool"])
    chosen = stratified_pick(in_pool, F.col("_pool_target"), seed, F.concat_ws(":", "split", "label", "pool"), [*cell, "pool"])
    chosen = chosen.groupBy(*cell, "user_id").agg(F.lit(True).alias("_chosen"))
    filled = strata.join(cells, cell).join(chosen, [*cell, "user_id"], "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))
    order = Window.partitionBy(*cell).orderBy((~F.col("_chosen")).cast("int"), F.when(~F.col("_chosen"), N.stable_hexdigest(seed, F.lit("fallback"), "split", "label", "user_id")), "user_id")
    out = filled.withColumn("_place", F.row_number().over(order)).where("_place <= _target").drop("_place", "_target", "_chosen")
    return out.withColumn("seed_order", N.stable_hexdigest(seed, F.lit("selected"), "split", "label", "user_id"))


def downsample_users(profile: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """As select_seeds, without pools: quotas by split and label, strata within."""
    rows = profile.where("split <> 'missing' and label <> 'missing'")
    splits = largest_remainder(rows.groupBy("split").agg(F.count(F.lit(1)).alias("_n")), "split", "_n", size, name="_split_quota").drop("_n")
    cells = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("_n")).join(splits, "split")
    cells = largest_remainder(cells, "label", "_n", F.col("_split_quota"), ["split"], "_cell_target").select("split", "label", "_cell_target")
    strata = with_strata(rows, ["tweet_count_hint", "followers_count", "following_count"], ["verified_bucket"], ["split", "label"]).join(cells, ["split", "label"])
    return stratified_pick(strata, F.col("_cell_target"), seed, F.concat_ws(":", "split", "label"), ["split", "label"]).drop("_cell_target")


def context_topk(edges: DataFrame, seeds: DataFrame, degrees: DataFrame, seed: int = 42, limits: dict[str, int] | None = None) -> DataFrame:
    """One-hop context of seeds: (seed_id, candidate_id, category, links, degree, place).

    edges (source, target): follower to followed. Candidates linked with one seed only are dropped where their degree is above the 95th
    percentile of all candidates'. Per seed and category: most links, smallest degree, hash. degrees: (user_id, degree).
    """
    limits = limits or CONTEXT_LIMITS
    ids = seeds.select(F.col("user_id").alias("seed_id")).distinct()
    out = edges.join(ids, edges.source == ids.seed_id).select("seed_id", F.col("target").alias("candidate_id"), F.lit(True).alias("f"), F.lit(False).alias("b"))
    back = edges.join(ids, edges.target == ids.seed_id).select("seed_id", F.col("source").alias("candidate_id"), F.lit(False).alias("f"), F.lit(True).alias("b"))
    links = out.unionByName(back).groupBy("seed_id", "candidate_id").agg(F.bool_or("f").alias("f"), F.bool_or("b").alias("b"))
    links = links.join(ids.withColumnRenamed("seed_id", "candidate_id"), "candidate_id", "left_anti")
    per = links.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_seeds")).join(degrees.select(F.col("user_id").alias("candidate_id"), "degree"), "candidate_id", "left")
    per = per.withColumn("degree", F.coalesce("degree", F.lit(0)))
    cutoff = per.agg(N.percentile("degree", 0.95).alias("cutoff"))  # one row
    per = per.join(F.broadcast(cutoff)).where("not (n_seeds = 1 and degree > cutoff)").drop("cutoff")
    rows = links.join(per, "candidate_id").withColumn("category", F.when(F.col("f") & F.col("b"), "mutual").when(F.col("b"), "follower").otherwise("following"))
    rows = rows.withColumn("links", F.col("f").cast("int") + F.col("b").cast("int"))
    order = Window.partitionBy("seed_id", "category").orderBy(F.col("links").desc(), "degree", N.stable_hexdigest(seed, F.lit("context"), "seed_id", "category", "candidate_id"), "candidate_id")
    bound = F.element_at(F.create_map(*[F.lit(x) for p in limits.items() for x in p]), F.col("category"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(limits.values())).where(F.col("place") <= bound).select("seed_id", "candidate_id", "category", "links", "degree", "place")


def top_by_hash(rows: DataFrame, by: str, key: str, limit: int, seed: int, *names: str) -> DataFrame:
    """At most `limit` rows of each `by`, in hash order, with `place`."""
    order = Window.partitionBy(by).orderBy(N.stable_hexdigest(seed, *[F.lit(n) for n in names], by, key), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def finalize_tweets(candidates: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Of each user's candidates (user_id, tweet_id, ts): all up to `limit`; spread evenly over time if every time is known; else in hash order."""
    user = Window.partitionBy("user_id")
    rows = candidates.withColumn("_n", F.count(F.lit(1)).over(user)).withColumn("_dated", F.min(F.col("ts").isNotNull()).over(user))
    rows = rows.withColumn("_time", F.row_number().over(user.orderBy("ts", "tweet_id")) - 1)
    rows = rows.withColumn("_hash", F.row_number().over(user.orderBy(N.stable_hexdigest(seed, F.lit("final"), "user_id", "tweet_id"), "tweet_id")))
    even = F.array_contains(N.even_indices(F.col("_n"), limit), F.col("_time").cast("long"))
    return rows.where((F.col("_n") <= limit) | F.when(F.col("_dated"), even).otherwise(F.col("_hash") <= limit)).drop("_n", "_dated", "_time", "_hash")


def select_for_tasks(tweets: DataFrame, per_user: int = 20, least: int = 8, max_users: int | None = None, max_tweets: int | None = None, seed: int = 42) -> DataFrame:
    """Tweets for derived tasks: users with at least `least`, each user's top by hash, optional bounds by hash, in the order of author, time (unknown last) and id."""
    user = Window.partitionBy("user_id")
    rows = tweets.withColumn("_n", F.count(F.lit(1)).over(user)).where(F.col("_n") >= least).drop("_n")
    rows = top_by_hash(rows, "user_id", "tweet_id", per_user, seed, "derived").drop("place")
    if max_users is not None:
        users = rows.select("user_id").distinct().orderBy(N.stable_hexdigest(seed, F.lit("users"), "user_id"), "user_id").limit(max_users)
        rows = rows.join(users, "user_id", "left_semi")
    if max_tweets is not None:
        rows = rows.orderBy(N.stable_hexdigest(seed, F.lit("tweets"), "tweet_id"), "tweet_id").limit(max_tweets)
    return rows.orderBy("user_id", F.col("ts").asc_nulls_last(), "tweet_id")


def reference_closure(selected: DataFrame, tweets: DataFrame, references: str = "references") -> DataFrame:
    """selected and the tweets they reference, one step, that exist: (tweet_id, added)."""
    ids = selected.select("tweet_id").distinct()
    wanted = selected.select(F.explode(references).alias("tweet_id")).distinct().join(ids, "tweet_id", "left_anti")
    added = wanted.join(tweets.select("tweet_id").distinct(), "tweet_id", "left_semi")
    return ids.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def close_edges(edges: DataFrame, users: DataFrame, tweets: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, relation) both of whose ends are kept: users or tweets, as the relation has it."""
    u, t = users.select("user_id").distinct(), tweets.select("tweet_id").distinct()
    left = {"following": "u", "post": "u", "retweet": "t", "quote": "t", "reply": "t", "mention": "t"}
    right = {"following": "u", "post": "t", "retweet": "t", "quote": "t", "reply": "t", "mention": "u"}
    kinds = lambda sides, of: [k for k, v in sides.items() if v == of]
    ends = u.select(F.lit("u").alias("kind"), F.col("user_id").alias("id")).unionByName(t.select(F.lit("t").alias("kind"), F.col("tweet_id").alias("id")))
    side = lambda sides: F.when(F.col("relation").isin(*kinds(sides, "u")), "u").when(F.col("relation").isin(*kinds(sides, "t")), "t")
    rows = edges.dropDuplicates(["source_id", "target_id", "relation"]).withColumn("_l", side(left)).withColumn("_r", side(right))
    rows = rows.join(ends.toDF("_l", "source_id"), ["_l", "source_id"], "left_semi").join(ends.toDF("_r", "target_id"), ["_r", "target_id"], "left_semi")
    return rows.select("source_id", "target_id", "relation")


def downsample(profile: DataFrame, tweets: DataFrame, edges: DataFrame, size: int, seed: int = 42) -> dict[str, DataFrame]:
    """A smaller closed sample: users, their tweets, and the edges between what is kept."""
    users = downsample_users(profile, size, seed)
    kept = tweets.join(users.select("user_id"), "user_id", "left_semi")
    authored = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("authored"))
    return {"users": users.join(authored, "user_id", "left").withColumn("authored", F.coalesce("authored", F.lit(0))), "tweets": kept, "edges": close_edges(edges, users, kept)}


def endpoint_errors(edges: DataFrame, users: DataFrame, tweets: DataFrame) -> DataFrame:
    """(relation, errors): edges with an end that is not there."""
    kept = close_edges(edges, users, tweets).groupBy("relation").agg(F.count(F.lit(1)).alias("_ok"))
    return edges.dropDuplicates(["source_id", "target_id", "relation"]).groupBy("relation").agg(F.count(F.lit(1)).alias("_all")).join(kept, "relation", "left").select("relation", (F.col("_all") - F.coalesce("_ok", F.lit(0))).alias("errors"))


def ratio_delta(actual: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: the largest difference of a key's share between two tables of (key, n); keys that one lacks have a share of 0 there."""
    whole = Window.partitionBy(F.lit(0))
    share = lambda df, name: df.groupBy(key).agg(F.sum("n").alias("n")).select(key, (F.col("n") / F.nullif(F.sum("n").over(whole), F.lit(0))).alias(name))
    both = share(actual, "a").join(share(target, "b"), key, "full")
    return both.agg(F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("delta"))


def validate(edges: DataFrame, users: DataFrame, tweets: DataFrame, targets: dict[str, DataFrame], budget: int) -> DataFrame:
    """One row: endpoint errors, share differences of split and label, tweets, and whether all are within bounds. targets: (key, n) tables for split and label."""
    errors = endpoint_errors(edges, users, tweets).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("endpoint_errors"))
    out = errors
    for key in ("split", "label"):
        delta = ratio_delta(users.groupBy(key).agg(F.count(F.lit(1)).alias("n")), targets[key], key).withColumnRenamed("delta", f"{key}_delta")
        out = out.join(delta)  # one row each
    out = out.join(tweets.agg(F.count(F.lit(1)).alias("tweets")))
    passed = (F.col("endpoint_errors") == 0) & (F.col("split_delta") <= MAX_SPLIT_DELTA) & (F.col("label_delta") <= MAX_LABEL_DELTA) & (F.col("tweets") <= budget)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
