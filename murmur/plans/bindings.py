"""The given tables as the entities of the graph pipeline: users, posts, follows, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as sinks have them: sums differ in the last bits by the order of rows."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def posts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.col("event_id").cast("string").alias("tweet_id"), F.col("ts"), F.col("event_type").alias("kind"), "value", "props", "event_id")


def users(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("user_id").distinct()


def follows(spark: SparkSession, d: str) -> DataFrame:
    """(source, target): each event's user and that of the next event, without self-loops; one edge may be there several times.

    The order is total, so events are numbered within hours and the next one of an hour's last is the first of the next hour that has any.
    """
    e = table(spark, d, "events").select("ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("h"))
    within = Window.partitionBy("h").orderBy("ts", "event_id")
    rows = e.withColumn("next", F.lead("user_id").over(within))
    heads = e.groupBy("h").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = heads.withColumn("after", F.lead("first").over(Window.orderBy("h"))).select("h", "after")  # a row per hour
    rows = rows.join(F.broadcast(after), "h").withColumn("next", F.coalesce("next", "after")).where("next is not null and next <> user_id")
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    return rows.select(name("user_id").alias("source"), name("next").alias("target"))


def split_of(key: str) -> Column:
    k = F.col(key) % 10
    return F.when(k <= 6, "train").when(k == 7, "valid").otherwise("test")


def members(spark: SparkSession, d: str) -> DataFrame:
    """Documents as members of communities (their sources), labelled by toxicity: user_id, community_id, split, label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col("source").alias("community_id")).join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").cast("string").alias("user_id"), "community_id", split_of("doc_id").alias("split"), F.when(F.col("toxic") == 1, "bot").when(F.col("toxic") == 0, "human").otherwise("missing").alias("label"))


#: SQL of the same bindings, for the oracles.
POSTS = "posts as (select 'u' || user_id as user_id, event_id::varchar as tweet_id, ts, event_type as kind, value, props, event_id from events)"
FOLLOWS = "follows as (select 'u' || user_id as source, 'u' || nxt as target from (select user_id, lead(user_id) over (order by ts, event_id) as nxt from events) where nxt is not null and nxt <> user_id)"
MEMBERS = """members as (select d.doc_id::varchar as user_id, source as community_id, case when d.doc_id % 10 <= 6 then 'train' when d.doc_id % 10 = 7 then 'valid' else 'test' end as split,
    case when toxic = 1 then 'bot' when toxic = 0 then 'human' else 'missing' end as label from documents d left join (select doc_id, max(toxic) as toxic from labels group by 1) l on d.doc_id = l.doc_id)"""
KNN = """vecs as (select vec_id, embedding::double[] as v, label from embeddings),
sims as (select a.vec_id as source, b.vec_id as target, list_cosine_similarity(a.v, b.v) as weight from vecs a join vecs b on a.vec_id <> b.vec_id),
knn as (select *, row_number() over (partition by source order by round(weight, 12) desc, target) as rank from sims qualify rank <= {k})"""
EDGES = "edges as (select least(source, target) as a, greatest(source, target) as b, max(weight) as weight, count(distinct source) as support from knn group by 1, 2)"
