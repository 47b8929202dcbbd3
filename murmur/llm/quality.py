"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

A text's score is the sum of log p_target/p_raw over its byte windows, divided by their number; a fixed threshold decides for every
document. Base rules (too few words, too many repeated eight-word windows) fail a document first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmur.llm import kernels as K
from murmur.llm import ngrams
from murmur.llm.base import pieces, table

#: Bytes in a window of the models.
WINDOW = 4
#: Least mean log-likelihood ratio of a kept document, in nats a window.
THRESHOLD = -0.25
REPEAT = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


def _plain(text: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, from the strings themselves."""
    lines = [x for x in text.split(b"\n") if x.split()]
    w = text.split()
    seen = Counter(zip(*(w[k:] for k in range(REPEAT)), strict=False))
    marked, to = 0, 0
    for k, window in enumerate(zip(*(w[k:] for k in range(REPEAT)), strict=False)):
        if seen[window] > 1:
            marked += k + REPEAT - max(k, to)
            to = k + REPEAT
    return len(lines) - len(set(lines)), marked


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of joined UTF-8 texts. Equal lines and windows are found by hashes and confirmed on their bytes; a row where
    hashes are equal and bytes are not is counted from its strings."""
    blank = K.blank(data)
    starts, ends, first = K.runs(~blank, offsets)
    rows = len(offsets) - 1
    chars = ((data & 0xC0) != 0x80) & ~blank
    hashes = K.Hashes(data)
    doubtful = np.zeros(rows, bool)
    # lines with a word: runs between newlines that hold a non-blank byte
    newline = data == 10
    at, to, line_first = K.runs(~newline, offsets)
    words_before = np.concatenate([[0], np.cumsum(~blank)])
    has = words_before[to] > words_before[at]
    kept = np.concatenate([[0], np.cumsum(has)])[line_first]
    at, to = at[has], to[has]
    lines = hashes.of(at, to)
    row = np.repeat(np.arange(rows), np.diff(kept))
    # an equal earlier line: all but the first of each distinct line of a row
    order = np.lexsort((lines, row))
    x, y = order[:-1], order[1:]
    again = (lines[x] == lines[y]) & (row[x] == row[y])
    dup = np.bincount(row[y][again], minlength=rows)
    x, y = x[again], y[again]
    doubtful[row[y[to[x] - at[x] != to[y] - at[y]]]] = True
    doubtful[row[y[~K.equal(data, at[x], at[y], np.minimum(to[x] - at[x], to[y] - at[y]))]]] = True
    # words in windows of REPEAT words found twice or more in a row
    w = hashes.of(starts, ends)
    windows, window_first = K.grams(w, first, REPEAT)
    row = np.repeat(np.arange(rows), np.diff(window_first))
    word = np.arange(len(windows)) + (first[:-1] - window_first[:-1])[row]
    own = K.mix(windows ^ K.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    again = own[order][1:] == own[order][:-1]
    x, y = order[:-1][again], order[1:][again]
    twice = np.zeros(len(windows), bool)
    twice[x] = twice[y] = True
    mark = np.zeros(len(w) + REPEAT + 1, np.int64)
    np.add.at(mark, word[twice], 1)
    np.add.at(mark, word[twice] + REPEAT, -1)
    marked = np.cumsum(mark)[: len(w)] > 0
    wrong = row[x] != row[y]
    for k in range(REPEAT):
        wrong |= w[word[x] + k] != w[word[y] + k]
    doubtful[row[x[wrong]]] = doubtful[row[y[wrong]]] = True
    some = np.flatnonzero(marked)
    some = some[np.argsort(w[some], kind="stable")]
    x, y = some[:-1], some[1:]
    x, y = x[w[x] == w[y]], y[w[x] == w[y]]
    size = ends - starts
    wrong = (size[x] != size[y]) | ~K.equal(data, starts[x], starts[y], np.minimum(size[x], size[y]))
    for side in (x[wrong], y[wrong]):
        doubtful[np.searchsorted(first, side, side="right") - 1] = True
    n_repeat = K.sums(marked, first)
    for r in np.flatnonzero(doubtful):
        dup[r], n_repeat[r] = _plain(data[offsets[r] : offsets[r + 1]].tobytes())
    return {
        "n_words": np.diff(first), "word_chars": K.sums(chars, offsets), "n_symbols": K.sums(_is_symbol[data], offsets),
        "n_dup_lines": dup.astype(np.int64), "n_repeat_words": n_repeat,
    }


def judge(docs: DataFrame, ratio: np.ndarray, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): base counts, base_failed, llr and kept.

    A null or empty text has no words and fails the base rules; a text shorter than a window has an llr of 0. Repeated rows and null
    doc_ids each get a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                c = base_counts(data, offsets)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                total, n = ngrams.scores(data, offsets, ratio, window)
                llr = total / np.maximum(n, 1)
                out = [part.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                out += [pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, window: int = WINDOW) -> np.ndarray:
    """The log ratio of each bucket: counts over all of docs against those of at most ngrams.TRUSTED_ROWS trusted rows.

    Null ids and texts add nothing to the target; repeated rows count as often as they are there. Without trusted rows, or without texts, all
    ratios are 0. Further columns are ignored.
    """
    return ngrams.log_ratio(*ngrams.counts(ngrams.marked(docs, labels), window))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
