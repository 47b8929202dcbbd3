"""A training corpus from `documents`: five stages, each an operator of murmur.llm, each written as Parquet and read again.

toxicity rejects documents; near-duplicates keep one document of each group; secrets are masked in the texts; mixing puts all documents in
the order of the mixture; encoding returns token counts, digests of ids and decoded bytes, and the place in the mixture, in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import bpe, mixing, near_dup, secrets, toxicity
from murmur.llm.base import ordered, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those at hand, does not predict to be toxic.

    Null and empty texts, rows without doc_id and repeated rows are judged by their texts like all others; without labels of both classes all
    rows stay. Long texts are scored whole; an empty table stays empty; further columns stay as they are.
    """
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest doc_id, and one row of it.

    Of rows that share a doc_id, which are one document, the one with the smallest SHA-256 of its text stays (then by the other columns). Null
    and empty texts are near nothing, but of repeated rows one stays all the same. Rows without doc_id name no document: all of them stay.
    An empty table stays empty; further columns stay as they are.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = written(near_dup.groups(docs.select("doc_id", "text"), words=5, percent=80).select("doc_id", "kept"), "near")
    gone = found.where(~F.col("kept")).select("doc_id")
    repeated = found.where("doc_id is not null and kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = written(repeated, "repeated")
    # what goes grows with the table, so texts meet it by a merge join at every size
    without = gone.unionByName(repeated).distinct().hint("merge")
    rest = docs.join(without, "doc_id", "left_anti").select(*columns)
    if repeated.isEmpty():
        return rest
    # each task hands on one row of an id
    order = F.struct(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), F.to_json(F.struct(*[F.struct(c.alias("v")).alias(f"c{k}") for k, c in enumerate(columns)])))
    several = docs.join(repeated.hint("merge"), "doc_id", "left_semi")
    return rest.unionByName(several.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew where one was.

    Null and empty texts, rows without doc_id, repeated rows and all further columns stay as they are; an empty table stays empty.
    """
    return secrets.redact(docs, secrets.fit(docs, table(spark, sf_dir, "labels")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: files by ranges of its places, rows in each by place. `encode` reads that order.

    Null and unknown sources share a weight; rows that share a doc_id, or have none, go by the digests of their texts; equal rows are
    interchangeable. No row is left out, an empty table stays empty, and further columns stay as they are.
    """
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and mix_position of each document, in the order in which mixing wrote the documents.

    Readers split and reorder files, so each row takes its file's number and its place in the file with it: the result is sorted by them, and
    the places of the mixture are dealt to the rows of a source in that order. Null and empty texts have no ids; repeated rows each get a row; an
    empty table gives none.
    """
    docs = ordered(docs, "doc_id", "text", "source")
    # written, as sorting reads it twice
    found = written(bpe.digests(docs, *bpe.default_vocabulary(), keep=("source", "run", "row")), "digests")
    return mixing.positions(found, "run", "row").repartitionByRange("run", "row").sortWithinPartitions("run", "row").drop("run", "row")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier can't be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
