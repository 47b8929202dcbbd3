"""Mixing sources to target weights by a Pfair schedule, in DataFrame and SQL functions only.

Rows of a source are dealt, in the order of md5(doc_id), into blocks. With target weight w = q/Q, block k of a source is released at
slot floor(k/w) and due by slot ceil((k+1)/w). Each slot goes to the released block with the earliest deadline, so by any slot t a
source has had less than one block more or less than w*t. As the weights are multiples of 1/Q, the schedule repeats after Q slots: one
period (Q slots, whatever the data's size) is found by a fold and every block's slot follows by arithmetic. When a source is used up
its later slots stay empty and the others go on in their proportions. All rows are kept.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.base import fresh, table

#: Shares of the query and the pipeline, in thousandths; sources not listed share the weight of OTHER.
WEIGHTS = {"src0": 150, "src1": 120, "src2": 100, "src3": 90, "src4": 80, "src5": 70, "src6": 60, "src7": 50, "src8": 50, "src9": 40}
OTHER = "*"
OTHER_WEIGHT = 190
BLOCK = 8
#: Leading hex digits of the md5 that part a source, so that no window holds a whole source: 16**3 parts.
DIGITS = 3
NEW = ("stream", "block_no", "slot", "release", "deadline", "mix_position")


def shares(weights: dict[str, float], other: float, period: int) -> dict[str, int]:
    """Weights as whole parts of the period, at least one each, by largest remainders. Raises where they don't fit."""
    all_ = {**weights, OTHER: other} if other > 0 else dict(weights)
    if not all_ or min(all_.values()) <= 0 or len(all_) > period:
        raise ValueError("weights must be positive, and no more than the period's slots")
    total = sum(Fraction(v) for v in all_.values())
    exact = {k: Fraction(v) * period / total for k, v in all_.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k)):
        if sum(out.values()) < period:
            out[k] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda k: (out[k] - exact[k] if out[k] > 1 else -1, k))] -= 1
    return out


def schedule_sql(parts: dict[str, int]) -> str:
    """One period as a SQL array of source numbers: a fold that gives each slot to the released block with the earliest deadline."""
    period, n = sum(parts.values()), len(parts)
    q = ", ".join(str(v) for v in parts.values())
    key = (  # deadline, then source number; no released block: a value above all
        f"transform(s.done, (k, i) -> if(k >= q[i] or (k * {period}L) div q[i] > t, {1 << 60}L,"
        f" (((k + 1) * {period}L + q[i] - 1) div q[i]) * {n}L + i))"
    )
    return f"""
        aggregate(sequence(0, {period - 1}),
            named_struct('done', array_repeat(0L, {n}), 'slots', cast(array() as array<int>)),
            (s, t) -> transform(array(named_struct('s', s, 'i', cast(array_min({key}) % {n} as int))),
                x -> named_struct('done', transform(x.s.done, (k, j) -> k + if(j = x.i, 1L, 0L)), 'slots', array_append(x.s.slots, x.i)))[0],
            s -> s.slots)""".replace("q[i]", f"array({q})[i]")


def period_table(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """stream, nth, slot0: the slot within a period of each stream's nth block in it. As many rows as the period has slots."""
    names = F.array(*[F.lit(k) for k in parts])
    slots = spark.range(1).select(F.posexplode(F.expr(schedule_sql(parts))).alias("slot0", "source_no"))
    w = Window.partitionBy("source_no").orderBy("slot0")
    return slots.select(names[F.col("source_no")].alias("stream"), (F.row_number().over(w) - 1).alias("nth"), F.col("slot0").cast("long"))


def mix(
    df: DataFrame, weights: dict[str, float], other: float = OTHER_WEIGHT, block: int = BLOCK, period: int = 1000,
    source: str = "source", key: str = "doc_id", digits: int = DIGITS, ties: Column | None = None, at: tuple[str, str] | None = None,
) -> DataFrame:
    """df with `stream`, `block_no`, `slot`, `release`, `deadline` and `mix_position`, which orders the mixture.

    ties: a text that orders rows of one key instead. at: two columns that order the rows instead of the key, a part (a window holds one, of one
    source) and a place in it, as `ordered` gives them. A null source counts as unlisted; unlisted sources form one stream with weight `other`, and are left out where that is 0. Repeated
    keys each keep their own place, in the order of a digest of the whole row, so only rows that are equal in all columns can change places; a
    null key orders as an empty one. An empty table gives no rows. Columns of df that have one of the new names are replaced; all others,
    whatever their names, stay as they are.
    """
    parts = shares(weights, other, period)
    listed = [k for k in parts if k != OTHER]
    named = lambda c: F.col(f"`{c}`")
    keep = [c for c in df.columns if c.lower() not in NEW]
    stream_, order_, tie_, part_, n_, before_, nth_, no_, q_, slot_ = fresh([*df.columns, *NEW], "stream_", "order", "tie", "part", "n", "before", "nth", "no", "q", "slot0")
    stream: Column = F.when(named(source).isin(listed), named(source)).otherwise(F.lit(OTHER)).alias(stream_)
    order = F.md5(F.coalesce(named(key).cast("string"), F.lit("")))
    part = named(at[0]) if at else F.substring(order, 1, digits)
    whole = F.to_json(F.struct(*[F.struct(named(c).alias("v")).alias(f"c{k}") for k, c in enumerate(keep)])) if ties is None else ties
    by = [named(at[1]).alias(order_), F.lit(None).alias(tie_)] if at else [order.alias(order_), F.sha2(whole, 256).alias(tie_)]
    rows = df.select(*[named(c) for c in keep], stream, part.alias(part_), *by).where(F.col(stream_).isin(list(parts)))
    # a row's number within its stream: the rows of the parts before its part, and its number within the part
    counts = df.select(stream, part.alias(part_)).groupBy(stream_, part_).agg(F.count(F.lit(1)).alias(n_))
    before = counts.withColumn(before_, F.sum(n_).over(Window.partitionBy(stream_).orderBy(part_)) - F.col(n_)).drop(n_)
    within = Window.partitionBy(stream_, part_).orderBy(order_, tie_)
    rows = rows.withColumn(nth_, F.row_number().over(within) - 1).drop(order_, tie_)
    # streams x parts rows at most (16**digits parts, or those of `at`), and one row for each slot of a period
    rows = rows.join(F.broadcast(before), [stream_, part_])
    q = F.create_map(*[F.lit(x) for k, v in parts.items() for x in (k, v)])[F.col(stream_)].cast("long")
    rows = rows.withColumn(no_, (F.col(before_) + F.col(nth_)).cast("long")).withColumn(q_, q).drop(nth_)
    block_no = F.expr(f"`{no_}` div {block}L")
    rows = rows.withColumn(nth_, F.expr(f"cast((`{no_}` div {block}L) % `{q_}` as int)"))
    rows = rows.join(F.broadcast(period_table(df.sparkSession, parts).toDF(stream_, nth_, slot_)), [stream_, nth_])
    slot = F.expr(f"(`{no_}` div {block}L) div `{q_}` * {period}L + `{slot_}`")
    return rows.select(
        *[named(c) for c in keep], F.col(stream_).alias("stream"), block_no.alias("block_no"), slot.alias("slot"), F.expr(f"((`{no_}` div {block}L) * {period}L) div `{q_}`").alias("release"),
        F.expr(f"((`{no_}` div {block}L + 1) * {period}L + `{q_}` - 1) div `{q_}`").alias("deadline"), (slot * block + F.expr(f"`{no_}` % {block}L")).alias("mix_position"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its stream, block, slot, release, deadline and place in the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, WEIGHTS)


def in_order(df: DataFrame) -> DataFrame:
    """The rows of df (doc_id, source, text, ...) in the order of the mixture: range-partitioned and sorted by mix_position, with the columns of df.

    Rows that share a doc_id go by the digest of their text.
    """
    (place,) = fresh(df.columns, "mix_position")
    out = mix(df.drop("mix_position"), WEIGHTS, ties=F.coalesce(F.col("text").cast("string"), F.lit("")))
    if place != "mix_position":  # a column of df has that name: it comes back by its own copy
        out = mix(df.withColumnRenamed("mix_position", place), WEIGHTS, ties=F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return out.select(*[F.col(place).alias(c) if c == "mix_position" else F.col(f"`{c}`") for c in df.columns])


def positions(df: DataFrame, part: str, place: str) -> DataFrame:
    """df (doc_id, source, ...) with mix_position: the schedule's places for each source's rows in the order of two columns, as `ordered` gives them.

    For a table that `in_order` has put in order and that was written since, these are the places it found.
    """
    out = mix(df, WEIGHTS, at=(part, place))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "mix_position"], "mix_position")


def oracle_sql() -> str:
    parts = shares(WEIGHTS, OTHER_WEIGHT, 1000)
    q = "[" + ", ".join(f"{v}::bigint" for v in parts.values()) + "]"
    names = "[" + ", ".join(f"'{k}'" for k in parts) + "]"
    listed = ", ".join(f"'{k}'" for k in parts if k != OTHER)
    n, period = len(parts), sum(parts.values())
    key = f"list_min(list_transform(range(1, {n + 1}), lambda i: case when done[i] >= {q}[i] or (done[i] * {period}) // {q}[i] > t then {1 << 60} else (((done[i] + 1) * {period} + {q}[i] - 1) // {q}[i]) * {n} + i - 1 end))"
    return f"""
with recursive plan as (
    select 0 as t, [{", ".join(["0::bigint"] * n)}] as done, null::bigint as picked
    union all
    select t + 1, list_transform(range(1, {n + 1}), lambda j: done[j] + case when j - 1 = p then 1 else 0 end), p
    from (select t, done, {key} % {n} as p from plan where t < {period})
), slots as (
    select {names}[picked + 1] as stream, t - 1 as slot0, row_number() over (partition by picked order by t) - 1 as nth from plan where picked is not null
), numbered as (
    select doc_id, source, stream, row_number() over (partition by stream order by md5(coalesce(doc_id::varchar, ''))) - 1 as no
    from (select doc_id, source, case when source in ({listed}) then source else '{OTHER}' end as stream from documents)
), parts as (select unnest({names}) as stream, unnest({q}) as q)
select doc_id, source, stream, no // {BLOCK} as block_no, (no // {BLOCK} // q) * {period} + slot0 as slot,
    (no // {BLOCK} * {period}) // q as release, ((no // {BLOCK} + 1) * {period} + q - 1) // q as deadline,
    ((no // {BLOCK} // q) * {period} + slot0) * {BLOCK} + no % {BLOCK} as mix_position
from numbered join parts using (stream) join slots using (stream) where slots.nth = (no // {BLOCK}) % q"""
