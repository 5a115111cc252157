"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths, beside the plain counts.

For each text and each length n of GRAMS the characters inside n-grams that occur twice or more in the text
are measured as a share of the characters of all words (overlaps count once), and so are the characters of
lines equal to an earlier line. A document is kept if the base rules hold (ten words or more, at most a
fifth of its words in repeated five-word windows) and no share exceeds its limit.

Hashes are 64 bits wide; all windows of a text are compared, whatever its length. Work is one pass over
Arrow batches in slices of about a megabyte of text, with no shuffle.

Defined cases: a null or empty text has zero words and fails the base rules; repeated rows and null doc_ids
each get their own result row; very long texts are measured whole, a slice of their own; a share equal to its limit passes; an empty table
gives an empty result; other columns, whatever their names, are ignored (or kept, by keep_good).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import PLAIN, gram_hashes, gram_inside, mix, range_hashes, runs, words_of
from .common import bounded_batches, slices

#: N-gram length and the largest share of characters inside duplicated n-grams of that length.
GRAMS = {5: 0.20, 7: 0.18, 10: 0.15}
#: The largest share of characters in repeated lines.
MOST_IN_LINES = 0.30
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, gram_shares array<double>, base_failed boolean, kept boolean"


def _twice(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(k), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _sums(per: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and shares of each text of the column."""
    w = words_of(column)
    n_texts, n = len(w.texts) - 1, len(w.start)
    upto = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = upto[w.end] - upto[w.start]
    n_words, word_chars = w.counts, _sums(chars, w.first)
    h, of = w.hashes(), w.of
    salt = mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(77))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(SYMBOLS[w.data], w.texts)}
    shares = []
    for length in sorted(set(GRAMS) | {WINDOW}):
        g, inside = gram_hashes(h, length), gram_inside(w, length)
        at = np.flatnonzero(inside)
        again = at[_twice(g[at] ^ salt[of[at]])]
        cover = np.zeros(n + 1, dtype=np.int64)
        cover[again] += 1
        np.subtract.at(cover, again + length, 1)
        covered = np.cumsum(cover)[:n] > 0
        if length == WINDOW:
            out["n_repeat_words"] = _sums(covered, w.first)
        if length in GRAMS:
            shares.append(_sums(chars * covered, w.first) / np.maximum(word_chars, 1))
    out["gram_shares"] = np.array(shares).reshape(len(GRAMS), n_texts)
    # lines: split at \n, those with a word only
    a, b = runs(w.data != 0x0A, w.texts)
    wordy = np.concatenate([[0], np.cumsum(PLAIN[w.data], dtype=np.int64)])
    a, b = (x[wordy[b] > wordy[a]] for x in (a, b))
    line_of = np.searchsorted(w.texts, a, side="right") - 1
    key = range_hashes(w.data, a, b) ^ salt[line_of]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    first = np.searchsorted(line_of, np.arange(n_texts + 1))
    line_chars = upto[b] - upto[a]
    out["n_dup_lines"] = _sums(later, first)
    out["line_share"] = _sums(line_chars * later, first) / np.maximum(_sums(line_chars, first), 1)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * n_words)
    limits = np.array([GRAMS[k] for k in sorted(GRAMS)])[:, None]
    out["kept"] = ~out["base_failed"] & (out["gram_shares"] <= limits).all(axis=0) & (out["line_share"] <= MOST_IN_LINES)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = measure(batch.column("text"))
        shares = pa.ListArray.from_arrays(np.arange(0, x["gram_shares"].size + 1, len(GRAMS), dtype=np.int32), x["gram_shares"].T.ravel())
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x[k].astype(np.int64)) for k in names), pa.array(x["line_share"].astype(float)), shares, pa.array(x["base_failed"]), pa.array(x["kept"])],
            ["doc_id", *names, "line_share", "gram_shares", "base_failed", "kept"],
        )


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts, shares and verdict of every row of docs."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns as they are; judged in the same pass, so no join is needed."""
    bounded_batches(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept = batch.filter(pa.array(measure(batch.column("text"))["kept"]))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(passed, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _covered_sql(n: int) -> str:
    return f"""g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))),
c{n} AS (SELECT r, count(*) AS words, sum(length(w[p])) AS chars FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS p FROM g{n} WHERE n > 1) JOIN d USING (r) GROUP BY r)"""


OP9_SQL = (
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
"""
    + ",\n".join(_covered_sql(n) for n in GRAMS)
    + r""",
ls AS (SELECT r, i, string_split(text, chr(10))[i] AS line FROM (SELECT r, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
ln AS (SELECT r, length(line) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
la AS (SELECT r, count(*) FILTER (WHERE again) AS dup, coalesce(sum(chars) FILTER (WHERE again), 0) / sum(chars) AS share FROM ln GROUP BY r),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c5.words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(c5.chars, 0) AS a, coalesce(c7.chars, 0) AS b, coalesce(c10.chars, 0) AS c, coalesce(share, 0) AS share
  FROM d LEFT JOIN la USING (r) LEFT JOIN c5 USING (r) LEFT JOIN c7 USING (r) LEFT JOIN c10 USING (r)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
"""
    + f"NOT base_failed AND a / greatest(word_chars, 1) <= {GRAMS[5]} AND b / greatest(word_chars, 1) <= {GRAMS[7]} AND c / greatest(word_chars, 1) <= {GRAMS[10]} AND share <= {MOST_IN_LINES} AS kept FROM y"
)
