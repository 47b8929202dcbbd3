"""Queries of this subpackage and their SQL."""

from murmur.llm import bpe, importance, media, mixing, near_dup, quality, repeats, secrets, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_repeats": repeats.op4_repeats,
    "op5_media": media.op5_media,
    "op6_importance": importance.op6_importance,
    "op7_bpe": bpe.op7_bpe,
    "op8_secrets": secrets.op8_secrets,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: The others use models or formats that SQL can't express; tests/llm compares them with plain versions.
ORACLES = {
    "op1_mixing": mixing.oracle_sql(),
    "op3_near_dup": near_dup.ORACLE_SQL,
    "op4_repeats": repeats.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
