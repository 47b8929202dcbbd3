"""Enrichment by rules and by a model service: post types, triplets and embeddings.

The service is any object made by a factory on the executor, one per partition, with `complete(system, user) -> str` or `embed(texts) -> list`.
Nothing about it, keys least of all, is in the plan. Tests use a deterministic stub.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from murmur.functions import normalize as N

POST_TYPE_SYSTEM = "Classify a post. Answer with JSON only: coarse_type (original, retweet, comment_reply, link_share), detail_type (original, retweet, reply, quote_comment, link_share, other), confidence (0 to 1)."
TRIPLET_SYSTEM = "Extract facts from a post. Answer with JSON only: triplets, a list of objects with subject, predicate and object."


def extract_json(text: str | None) -> dict[str, Any] | None:
    """The first JSON object in a model's answer: bare, fenced, or embedded in prose. None without one."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    body = re.sub(r"```(?:json)?", " ", text)
    for match in re.finditer(r"\{", body):
        try:
            value, _ = decoder.raw_decode(body, match.start())
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def _found_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (v := extract_json(t)) is None else json.dumps(v, sort_keys=True))


def json_of(text: str | Column) -> Column:
    """The first JSON object in each answer, as text."""
    return F.pandas_udf(_found_json, StringType())(N.col(text))


def message_content(body: dict[str, Any]) -> str:
    """The text of a chat answer: a string, or the joined text parts of a list. Raises without any."""
    choice = (body.get("choices") or [{}])[0]
    content = (choice.get("message") or {}).get("content", choice.get("text"))
    if isinstance(content, list):
        content = "".join(str(p.get("text", "")) for p in content if isinstance(p, dict))
    if not content:
        raise ValueError("the answer has no content")
    return str(content)


def embedding_vectors(body: dict[str, Any], expected: int) -> list[list[float]]:
    """The vectors of an embedding answer in the order of their index. Raises where their number is not the expected one."""
    rows = sorted(enumerate(body.get("data") or []), key=lambda r: r[1].get("index", r[0]))
    if len(rows) != expected:
        raise ValueError(f"{len(rows)} vectors instead of {expected}")
    return [[float(x) for x in r["embedding"]] for _, r in rows]


def read_settings(text: str, environment: dict[str, str], names: tuple[str, ...]) -> dict[str, str]:
    """Settings by name: the environment first, then lines NAME=value (quotes and comments allowed). For the driver or a client; never for a plan."""
    lines = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, _, v = line.partition("=")
            lines[k.strip()] = v.strip().strip("'\"")
    return {n: v for n in names if (v := environment.get(n) or lines.get(n))}


def normalize_triplets(body: str | Column) -> Column:
    """array<struct(subject, predicate, object)> from a JSON text with triplets as objects (with common aliases) or lists; incomplete ones go."""
    body = N.col(body)
    items = F.coalesce(*[F.from_json(F.get_json_object(body, p), "array<string>") for p in ("$.triplets", "$.triples", "$.facts")], F.from_json(F.lit("[]"), "array<string>"))

    def one(x: Column) -> Column:
        as_list = F.from_json(x, "array<string>")
        pick = lambda i, *names: F.trim(F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in names], F.try_element_at(as_list, F.lit(i))))
        return F.struct(pick(1, "subject", "s", "head").alias("subject"), pick(2, "predicate", "p", "relation").alias("predicate"), pick(3, "object", "o", "tail").alias("object"))

    whole = lambda t: (F.coalesce(t["subject"], F.lit("")) != "") & (F.coalesce(t["predicate"], F.lit("")) != "") & (F.coalesce(t["object"], F.lit("")) != "")
    return F.filter(F.transform(items, one), whole)


def triplet_text(triplets: str | Column, fallback: str | Column) -> Column:
    """Triplets as lines `subject | predicate | object`, or the fallback without any."""
    lines = F.array_join(F.transform(N.col(triplets), lambda t: F.concat_ws(" | ", t["subject"], t["predicate"], t["object"])), "\n")
    return F.when(F.size(N.col(triplets)) > 0, lines).otherwise(N.excerpt(fallback))


def triplet_prompt(text: str | Column) -> Column:
    return F.concat(F.lit("Post:\n"), N.col(text))


def post_type_prompt(text: str | Column, **facts: str | Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Post: "), N.col(text)), *[F.concat(F.lit(f"{k}: "), F.coalesce(N.col(v).cast("string"), F.lit("unknown"))) for k, v in facts.items()])


class RateLimiter:
    """At most `limit` calls within any `window` seconds, by a sliding window; for one process."""

    def __init__(self, limit: float, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.window, self.clock, self.sleep, self.calls = max(1, int(limit)), window, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= self.window:
            self.calls.popleft()
        if len(self.calls) >= self.limit:
            self.sleep(self.window - (now - self.calls[0]))
            return self.wait()
        self.calls.append(now)


def call_with_retries(call: Callable[[], Any], attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str | None]:
    """(result, None), or (None, error) after all attempts; pauses grow by the attempt."""
    error = "no attempt"
    for k in range(1, attempts + 1):
        try:
            return call(), None
        except Exception as e:  # the service's own errors are many; each becomes a row
            error = f"{type(e).__name__}: {e}"
            if k < attempts:
                sleep(pause * k)
    return None, error


def complete(rows: DataFrame, factory: Callable[[], Any], system: str, prompt: str = "prompt", per_minute: float = 120.0, attempts: int = 3, pause: float = 2.0, workers: int = 4) -> DataFrame:
    """rows with `answer` (the JSON object found, as text) and `error`. `workers` partitions share the budget of calls evenly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = factory(), RateLimiter(per_minute / workers)
        for pdf in batches:
            answers, errors = [], []
            for text in pdf[prompt]:
                limiter.wait()
                found, error = call_with_retries(lambda t=text: client.complete(system, t), attempts, pause)
                value = extract_json(found)
                answers.append(None if value is None else json.dumps(value, sort_keys=True))
                errors.append(error if value is None and error else None if value is not None else "no JSON object in the answer")
            yield pdf.assign(answer=answers, error=errors)

    return rows.repartition(workers).mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "answer string", "error string"]))


def classify_post_types(tweets: DataFrame, factory: Callable[[], Any] | None = None, mode: str = "hybrid") -> DataFrame:
    """tweets (tweet_id, user_id, text, references, urls) with coarse, detail, confidence, source and error.

    heuristic: rules, and original where none decides; llm: the service alone; hybrid: rules first, the service for the rest.
    """
    if mode not in ("heuristic", "hybrid", "llm") or (factory is None and mode != "heuristic"):
        raise ValueError("modes are heuristic, and with a service hybrid and llm")
    ruled = tweets.withColumn("_p", N.post_type("text", "references", "urls"))
    fixed = ruled if mode != "llm" else ruled.where(F.lit(False))
    if mode == "hybrid":
        fixed = fixed.where("_p.coarse is not null")
    ids = ["tweet_id", "user_id"]
    done = fixed.select(*ids, F.coalesce("_p.coarse", F.lit("original")).alias("coarse"), F.coalesce("_p.detail", F.lit("original")).alias("detail"), F.col("_p.confidence").alias("confidence"), F.lit("rule").alias("source"), F.lit(None).cast("string").alias("error"))
    if mode == "heuristic":
        return done
    rest = tweets if mode == "llm" else ruled.where("_p.coarse is null")
    asked = complete(rest.select(*ids, post_type_prompt("text").alias("prompt")), factory, POST_TYPE_SYSTEM)
    part = lambda k: F.get_json_object("answer", f"$.{k}")
    asked = asked.withColumn("_r", N.post_type_response(part("coarse_type"), part("detail_type"), part("confidence")))
    got = asked.select(*ids, *[F.when(F.col("error").isNull(), F.col(f"_r.{k}")).alias(k) for k in ("coarse", "detail", "confidence")], F.lit("service").alias("source"), "error")
    return done.unionByName(got)


def extract_triplets(tweets: DataFrame, factory: Callable[[], Any]) -> DataFrame:
    """tweets (tweet_id, user_id, ord, text) with triplets, triplet_text and error."""
    asked = complete(tweets.withColumn("prompt", triplet_prompt("text")), factory, TRIPLET_SYSTEM)
    rows = asked.withColumn("triplets", normalize_triplets("answer"))
    return rows.withColumn("triplet_text", triplet_text("triplets", "text")).drop("prompt", "answer")


def embed(rows: DataFrame, factory: Callable[[], Any], text: str = "text", batch: int = 64, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """rows with `embedding`, by calls of `batch` texts, and `error`: a call that still fails after its attempts leaves its rows without an embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            texts, out, errors = pdf[text].fillna("").tolist(), [], []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                found, error = call_with_retries(lambda p=part: client.embed(p), attempts, pause)
                if found is not None and len(found) != len(part):
                    found, error = None, f"{len(found)} embeddings for {len(part)} texts"
                out += [None] * len(part) if found is None else [[float(x) for x in v] for v in found]
                errors += [error if found is None else None] * len(part)
            yield pdf.assign(embedding=out, error=errors)

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "embedding array<double>", "error string"]))
