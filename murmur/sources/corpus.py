"""A raw or sampled corpus folder as typed tables, with canonical ids from the start, and the stages' tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.sources import scans

USER = (
    "id string, id_str string, rest_id string, user_id string, username string, name string, description string, created_at string, verified string, followers_count string, friends_count string, following_count string,"
    " statuses_count string, tweet_count string, public_metrics struct<followers_count:string,following_count:string,listed_count:string,tweet_count:string>"
)
TWEET = (
    "id string, id_str string, tweet_id string, author_id string, text string, created_at string, lang string, source string, in_reply_to_user_id string, referenced_tweets array<struct<id:string,type:string>>,"
    " entities struct<urls:array<struct<expanded_url:string,display_url:string,url:string>>>, public_metrics struct<like_count:string,reply_count:string,retweet_count:string,quote_count:string>"
)


class Corpus:
    """The tables of a folder: users, tweets, edges, and what stages have written under analysis/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _json(self, stem: str, schema: str) -> DataFrame:
        path = scans.resolve(self.spark, self.root, f"{stem}.jsonl", f"{stem}.json")
        return scans.read_records(self.spark, path, schema, "place")

    def maps(self, name: str) -> DataFrame:
        rows = scans.read_csv(self.spark, scans.resolve(self.spark, self.root, f"{name}.csv"), "_order")
        clean = N.label(name) if name == "label" else N.split(name)
        return scans.read_map(rows, name, "_order").select(N.canonical_user_id("id").alias("user_id"), clean.alias(name))

    def users(self) -> DataFrame:
        """user_id, counts, verified_bucket, description, pools, split and label (missing where the maps lack them)."""
        u = self._json("user", USER)
        m = "public_metrics"
        rows = u.select(
            N.canonical_user_id(N.user_id("id", "user_id", "id_str", "rest_id")).alias("user_id"), "username", "description", N.parse_timestamp("created_at").alias("created"),
            N.verified_bucket("verified").alias("verified_bucket"), N.followers("followers_count", f"{m}.followers_count").alias("followers_count"),
            N.followings("friends_count", "following_count", f"{m}.following_count").alias("following_count"), N.tweet_counts("statuses_count", "tweet_count", f"{m}.tweet_count").alias("tweet_count_hint"), "place",
        )
        rows = scans.first_of(rows, "user_id")
        rows = rows.withColumn("degree_proxy", N.degree_proxy("followers_count", "following_count")).withColumn("pool", N.pool("tweet_count_hint"))
        rows = rows.withColumn("primary_pool", F.col("pool") == "primary").withColumn("sparse_pool", F.col("pool") == "sparse").drop("pool")
        for name in ("split", "label"):
            rows = rows.join(self.maps(name), "user_id", "left").withColumn(name, F.coalesce(name, F.lit("missing")))
        return rows

    def tweets(self) -> DataFrame:
        """tweet_id, user_id, text, ts, lang, references, urls, and flags, one row per tweet."""
        shards = scans.shards(self.spark, self.root)
        if shards:
            t = None
            for path in shards:
                part = scans.read_records(self.spark, path, TWEET, "place")
                t = part if t is None else t.unionByName(part)
        else:
            t = self._json("tweet", TWEET)
        empty = lambda kind: F.from_json(F.lit("[]"), kind)
        rows = t.select(
            N.user_id("id", "tweet_id", "id_str").alias("tweet_id"), N.canonical_user_id("author_id").alias("user_id"), "text", N.parse_timestamp("created_at").alias("ts"), "lang", "source", "in_reply_to_user_id",
            F.coalesce("referenced_tweets", empty("array<struct<id:string,type:string>>")).alias("references"), F.coalesce("entities.urls", empty("array<struct<expanded_url:string,display_url:string,url:string>>")).alias("urls"),
            F.col("public_metrics").isNotNull().alias("has_metrics"), "place",
        )
        return scans.first_of(rows, "tweet_id")

    def raw_edges(self) -> DataFrame:
        return scans.read_csv(self.spark, scans.resolve(self.spark, self.root, "edge.csv"), "place").select("source_id", "target_id", "relation", "place")

    def follows(self) -> DataFrame:
        """(source, target): follower to followed, canonical."""
        e = N.follow_edge("source_id", "target_id", "relation")
        rows = self.raw_edges().select(e.alias("e")).where("e is not null")
        return rows.select(N.canonical_user_id("e.source").alias("source"), N.canonical_user_id("e.target").alias("target"))

    def tweet_edges(self) -> DataFrame:
        """(source_id, target_id, relation, place) of posts, retweets, quotes, replies and mentions; users' ids canonical."""
        kind = N.tweet_relation("relation")
        rows = self.raw_edges().select("source_id", "target_id", kind.alias("relation"), "place").where("relation is not null")
        source = F.when(F.col("relation") == "post", N.canonical_user_id("source_id")).otherwise(F.col("source_id"))
        target = F.when(F.col("relation") == "mention", N.canonical_user_id("target_id")).otherwise(F.col("target_id"))
        return rows.select(source.alias("source_id"), target.alias("target_id"), "relation", "place")

    def edges(self) -> DataFrame:
        return self.tweet_edges().drop("place").unionByName(self.follows().select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("following").alias("relation")))

    # --- stages' tables

    def put(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        path = f"{self.root}/analysis/{name}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.parquet(path)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(scans.require_path(self.spark, f"{self.root}/analysis/{name}"))

    def has(self, name: str) -> bool:
        try:
            scans.require_path(self.spark, f"{self.root}/analysis/{name}/_SUCCESS")
        except FileNotFoundError:
            return False
        return True
