"""Secret scans in DataFrame and SQL functions only.

Base patterns find assignments, access keys and long hex runs. Two character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; any further run of token characters whose mean log-likelihood ratio per character
step is at least THRESHOLD becomes a span too. Positions are code points, found by running sums over matches and the gaps between them.

All of it takes time in proportion to a text and its spans: running sums go by blocks, as appending to an array copies it; a run is read from
its own bytes, in pieces, as finding a place in a string counts from its start; masked texts are cut as UTF-32, where places are known.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.base import fresh, table

# Fixed values of the query's contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run that is too short fails from each of its places, so this equals AKIA[A-Z0-9]+ of 16 or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs of the alphabet that are scored.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least mean log-likelihood ratio, in nats a step.
THRESHOLD = 2.5
#: Bounds of the labelled samples: trusted documents whose words are ordinary identifiers, and random strings of each alphabet.
TRUSTED_ROWS = 1_000
RANDOM_ROWS = 2_000
SMOOTH = 0.5
#: Steps from each character that its unigram model stands for.
WEIGHT = 5.0

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Values that one fold appends to an array; characters of a run that are split at a time.
BLOCK, PIECE = 512, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Running results of an associative op over an array of ints, of which start is the neutral value: within blocks, then over the blocks."""
    none = F.array().cast("array<int>")

    def blocks(v: Column) -> Column:
        part = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(part, lambda p: fold(p, none, F.lit(start)))

    def fold(p: Column, out: Column, first: Column) -> Column:
        return F.aggregate(p, out, lambda s, x: F.array_append(s, op(F.coalesce(F.try_element_at(s, F.lit(-1)), first), x)))

    def joined(done: Column) -> Column:
        before = fold(F.transform(done, lambda d: F.element_at(d, -1)), F.array(F.lit(start)), F.lit(start))
        return _let(before, lambda w: F.flatten(F.transform(done, lambda d, k: F.transform(d, lambda x: op(F.element_at(w, k + 1), x)))))

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(blocks(v), joined))).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0, tokens: bool = False) -> Column:
    """Spans of a pattern's matches, leftmost and non-overlapping; matches whose group is shorter than `least` are dropped after they consumed text.

    tokens: each span also has its match.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = lambda x: F.transform(x, F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits

    def found(h: Column) -> Column:
        ends = _scan(F.zip_with(sizes(h), F.slice(sizes(gaps), 1, F.size(h)), lambda x, g: x + g), lambda x, y: x + y, 0)
        parts = F.arrays_zip(ends.alias("e"), h.alias("h"), sizes(values).alias("v"))
        span = lambda x: F.struct((x["e"] - F.length(x["h"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), *([x["h"].alias("token")] if tokens else []))
        return F.transform(F.filter(parts, lambda x: x["v"] >= least) if least else parts, span)

    none = F.from_json(F.lit("[]"), SPAN.replace("end:int", "end:int,token:string") if tokens else SPAN)
    return F.when(text.rlike(pattern), _let(hits, found)).otherwise(none)


def samples(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED_ROWS, random: int = RANDOM_ROWS) -> DataFrame:
    """Labelled samples (token, random): words of at most `trusted` documents of quality 1 (without base matches), and digests in hex, base 64 and capitals."""
    spark = docs.sparkSession
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(trusted)
    clean = F.regexp_replace("text", "|".join((ASSIGN, ACCESS, HEX)), " ")
    words = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select(F.explode(F.regexp_extract_all(clean, F.lit(f"[A-Za-z0-9+/_=-]{{4,{PIECE}}}"), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    strings = spark.range(random).select(
        F.explode(F.array(digest, F.substring(F.base64(F.unhex(digest)), 1, 43), F.regexp_replace(F.upper(F.substring(F.base64(F.unhex(digest)), 1, 43)), "[+/]", ""))).alias("token"), F.lit(True).alias("random"),
    )
    return words.unionByName(strings)


def train(labelled: DataFrame) -> list[float]:
    """log p_random(c2 | c1) - log p_ordinary(c2 | c1) for each pair of characters of the alphabet: one value a pair, whatever the sample's size."""
    n = len(ALPHABET)
    spark = labelled.sparkSession
    letters = F.split("token", "")
    pair = F.zip_with(F.slice(letters, 1, F.length("token") - 1), F.slice(letters, 2, F.length("token")), lambda x, y: F.concat(x, y))
    counts = labelled.where(F.length("token") >= 2).select("random", F.explode(pair).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = spark.range(n * n).select("id", F.concat(F.substring(F.lit(ALPHABET), (F.expr(f"id div {n}") + 1).cast("int"), F.lit(1)), F.substring(F.lit(ALPHABET), (F.col("id") % n + 1).cast("int"), F.lit(1))).alias("pair"))
    full = grid.join(counts, "pair", "left").na.fill(0, ["r", "o"]).withColumn("first", F.expr(f"id div {n}")).withColumn("second", F.col("id") % n)
    totals = full.groupBy("first").agg(F.sum("r").alias("sr"), F.sum("o").alias("so"))
    # a step that its sample lacks is as likely as its second character is on the whole
    whole = Window.partitionBy(F.lit(0))  # a row per character
    alone = full.groupBy("second").agg(F.sum("r").alias("ur"), F.sum("o").alias("uo"))
    alone = alone.select("second", *[((F.col(u) + SMOOTH) / (F.sum(u).over(whole) + SMOOTH * n)).alias(p) for u, p in (("ur", "pr"), ("uo", "po"))])
    log = lambda c, s, p: F.log((F.col(c) + WEIGHT * F.col(p)) / (F.col(s) + WEIGHT))
    rows = full.join(totals, "first").join(alone, "second").select("id", (log("r", "sr", "pr") - log("o", "so", "po")).alias("llr")).collect()  # n * n rows
    return [r.llr for r in sorted(rows, key=lambda r: r.id)]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character steps, for a token of the alphabet of at least two characters."""
    n = len(ALPHABET)
    # one literal each, where a list would be a node for each value
    table_ = F.from_json(F.lit(json.dumps([float(x) for x in model])), "array<double>")
    number = F.from_json(F.lit(json.dumps([ALPHABET.find(chr(c)) if c else -1 for c in range(128)])), "array<int>")
    at = lambda c: F.element_at(number, F.ascii(c) + 1)

    def steps(piece: Column) -> Column:
        return F.aggregate(
            F.split(piece, ""),
            F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum")),
            lambda s, c: _let(at(c), lambda x: F.struct(x.alias("at"), F.when(s["at"] >= 0, s["sum"] + F.element_at(table_, s["at"] * n + x + 1)).otherwise(s["sum"]).alias("sum"))),
            lambda s: s["sum"],
        )

    def total(raw: Column) -> Column:
        # neighbouring pieces share a character, so that each step is in one
        starts = F.sequence(F.lit(0), F.floor((F.octet_length(raw) - 2) / PIECE).cast("int"))
        return F.aggregate(F.transform(starts, lambda i: steps(F.substring(raw, i * PIECE + 1, F.lit(PIECE + 1)).cast("string"))), F.lit(0.0), lambda s, x: s + x)

    return F.when(F.length(token) > 1, _let(token.cast("binary"), total) / (F.length(token) - 1))


def _overlaps(base: Column, runs: Column) -> Column:
    """For each of some spans, whether one of base overlaps it. base is in the order of its starts."""

    def among(b: Column, reach: Column) -> Column:
        def last(x: Column) -> Column:
            """How many of base begin before the end of x: halving, in as many steps as an int has bits."""
            state = F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi"))
            more = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(_let(more(s), lambda m: F.when(F.element_at(b, m + 1)["start"] < x["end"], F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi")))))
            return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(b) + 1)).cast("int") + 1), state, step, lambda s: s["lo"])

        return F.transform(runs, lambda x: _let(last(x), lambda k: F.when(k > 0, F.element_at(reach, F.greatest(k, F.lit(1))) > x["start"]).otherwise(F.lit(False))))

    none = F.transform(runs, lambda x: F.lit(False))
    return F.when(F.size(base) > 0, _let(base, lambda b: _let(_scan(F.transform(b, lambda x: x["end"]), F.greatest, 0), lambda reach: among(b, reach)))).otherwise(none)


def _scanned(df: DataFrame, model: list[float], text: str, threshold: float) -> tuple[DataFrame, str, str]:
    """df with two more columns, base spans and all spans, and their names, which are none of df's."""
    t, base, runs, spans = fresh(df.columns, "_text", "_base", "_runs", "_spans")
    rows = df.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    own = F.col(t)
    rows = rows.withColumn(base, F.array_sort(F.concat(_spans(own, ASSIGN, 0, 2, 8), _spans(own, ACCESS, 1), _spans(own, HEX, 2))))
    rows = rows.withColumn(runs, _spans(own, CANDIDATE, 3, tokens=True))
    # models first, as few runs pass them
    likely = F.filter(F.col(runs), lambda x: mean_ratio(x["token"], model) >= threshold)
    free = lambda x: F.transform(F.filter(F.arrays_zip(x.alias("x"), _overlaps(F.col(base), x).alias("o")), lambda z: ~z["o"]), lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["kind"].alias("kind"), z["x"]["end"].alias("end")))
    found = F.when(F.size(runs) > 0, _let(likely, free)).otherwise(F.from_json(F.lit("[]"), SPAN))
    return rows.withColumn(spans, F.array_sort(F.concat(base, found))).drop(t, runs), base, spans


def scan(df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with `base` and `spans`, arrays of (start, kind, end) in the order of start and kind; kinds are numbers of KINDS.

    A null text is an empty one and has no spans. A run found by the models is a span only where it overlaps no base span. Repeated rows
    each get their spans, an empty table gives no rows, and columns of df named base or spans are replaced; all others stay as they are.
    """
    rows, base, spans = _scanned(df, model, text, threshold)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base", "spans")], F.col(base).alias("base"), F.col(spans).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(df: DataFrame, model: list[float]) -> DataFrame:
    """One row per row of df (doc_id, text): the counts of base spans, their digest, and all spans as text. Null texts have no spans; null ids
    and repeated rows each keep their row; further columns are ignored."""
    rows, base, spans = _scanned(df.select("doc_id", "text"), model, "text", THRESHOLD)
    n = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(F.col(base)), 256).alias("base_sha256"), as_text(F.col(spans)).alias("spans"))


def redact(df: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """df with each span of its texts (overlapping ones as one) replaced by a mark, and n_chars, if there, counted anew.

    All rows and columns stay, whatever their names; null and empty texts stay as they are, as do repeated rows.
    """
    rows, _, spans = _scanned(df, model, "text", THRESHOLD)

    def kept(s: Column, reach: Column) -> Column:
        """The places [from, to) between spans: a span that the earlier ones don't reach begins a new gap; the last gap ends with the text."""
        starts = F.filter(F.transform(s, lambda x, k: F.struct(F.when(k > 0, F.element_at(reach, F.greatest(k, F.lit(1)))).otherwise(F.lit(0)).alias("a"), x["start"].alias("b"), k.alias("k"))), lambda g: (g["b"] >= g["a"]))
        return F.concat(F.transform(starts, lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"))), F.array(F.struct(F.element_at(reach, -1).alias("a"), F.length("text").alias("b"))))

    bom = F.unhex(F.lit("0000FEFF"))  # so that the decoder does not take one of the text's
    wide = F.encode(F.col("text").cast("string"), "UTF-32")
    cut = lambda w, g: F.decode(F.concat(bom, F.substring(w, g["a"] * 4 + 1, (g["b"] - g["a"]) * 4)), "UTF-32")
    reach = _scan(F.transform(F.col(spans), lambda x: x["end"]), F.greatest, 0)
    masked = _let(wide, lambda w: F.array_join(F.transform(_let(reach, lambda r: kept(F.col(spans), r)), lambda g: cut(w, g)), mark))
    some = F.size(spans) > 0
    out = rows.withColumn("text", F.when(some, masked).otherwise(F.col("text").cast("string")))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(dict(df.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The model of `train` from `samples`: without trusted words every step is judged by the random side and the alphabet alone."""
    return train(samples(docs, labels))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
