"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (FEATURES) are measured in one pass and written. They are standardised by the mean and
deviation over the training rows, mapped to WIDTH random cosines that approximate a Gaussian kernel, and the
normal equations are summed in each partition and then over all; their ridge solution scores a text.
Of the training rows a fifth (by hash) is kept from the equations: score bins of that fifth are pooled
by adjacent violators into a monotone map to probabilities, in which a thousandth of the raw score's logistic is mixed to keep
an order within plateaus.

All labelled rows train, but for held-out ones (crc32 of doc_id as text, modulo 3, is 1); labels, lang, source and
doc_id are no inputs. Only sums reach the driver: moments, two square matrices of WIDTH + 1, score bins.

Defined cases: null and empty texts have all statistics zero and get a score like others; several labels of one doc_id
count as their mean; null labels and labels of unknown documents don't train; without labels every score is 0.5;
a score of exactly 0.5 is predicted 1; very long texts are measured whole; repeated rows each get a result; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, words_of
from .common import bounded_batches, materialise, slices
from .language_id import held_out
from .quality_rules import measure

FEATURES = ("log_words", "word_length", "upper", "symbols", "bang", "pipes", "digits", "commas", "stops", "not_ascii", "echo", "repeated", "dup_lines", "distinct", "line_length", "longest_word", "gram_5", "gram_10")
WIDTH, RIDGE, BINS = 256, 1.0, 2000
SUMS = 16


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, features) of a text column."""
    w, m = words_of(column), measure(column)
    n_texts = len(w.texts) - 1
    size = np.maximum(np.diff(w.texts), 1)

    def share(of: bytes | np.ndarray) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[list(of) if isinstance(of, bytes) else of] = 1
        total = np.concatenate([[0], np.cumsum(table[w.data])])
        return (total[w.texts[1:]] - total[w.texts[:-1]]) / size

    h, of, n = w.hashes(), w.of, np.maximum(w.counts, 1)
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    key = h ^ mix(of.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(of[first], minlength=n_texts) if len(key) else np.zeros(n_texts)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, of, (w.end - w.start).astype(float))
    upper = share(bytes(range(65, 91)))
    lower = share(bytes(range(97, 123)))
    lines = share(b"\n") * size + 1
    cols = [
        np.log1p(w.counts), m["word_chars"] / n, upper / np.maximum(upper + lower, 1e-9), m["n_symbols"] / size, share(b"!"), share(b"|"), share(bytes(range(48, 58))), share(b","), share(b".?"), share(np.arange(128, 256)),
        np.bincount(of, same, minlength=n_texts) / n if len(h) else np.zeros(n_texts), m["n_repeat_words"] / n, m["n_dup_lines"] / lines, distinct / n, np.log1p(size / lines), np.log1p(longest), m["gram_shares"][0], m["gram_shares"][2],
    ]
    return np.stack([np.asarray(c, dtype=float) * (w.counts > 0) for c in cols], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)


class QualityModel:
    """Standardisation, cosines, weights and the calibrated steps."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: int = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1)
        d = len(mean)
        self.omega, self.phase = rng.standard_normal((d, width)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, width)
        self.weights, self.knots = np.zeros(width + 1), (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.concatenate([wave, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, *self.knots) + 0.001 / (1 + np.exp(-8 * (r - 0.5))), 0, 1)


def pool_adjacent(at: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit to the means total / weight at sorted places `at`."""
    blocks: list[list[float]] = []
    for a, t, w in zip(at, total, weight, strict=True):
        blocks.append([t, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, _, hi = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    xs = [p for b in blocks for p in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(xs), np.array(ys)


def _summed(rows: DataFrame, make) -> np.ndarray | None:
    """The sum over all rows of the arrays that `make` gives for a record batch: per partition, then in SUMS tasks, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                part = np.frombuffer(x.as_py(), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(first, "sums binary").repartition(SUMS).mapInArrow(again, "sums binary").collect()
    return sum(np.frombuffer(r.sums, float) for r in parts) if parts else None


def fit(measured: DataFrame, labels: DataFrame, width: int = WIDTH) -> QualityModel | None:
    """A model from (doc_id, x) and (doc_id, quality)."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = materialise(measured.join(marks, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside")))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("x"))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _summed(rows, moments)
    if total is None:
        return None
    d = len(FEATURES)
    mean = total[1 : d + 1] / total[0]
    model = QualityModel(mean, np.sqrt(np.maximum(total[d + 1 :] / total[0] - mean * mean, 0)), width)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.lift(_matrix(batch.column("x"))), batch.column("y").to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where("not aside"), normal)
    if sums is None:
        sums = _summed(rows, normal)
    n = width + 1
    model.weights = np.linalg.solve(sums[: n * n].reshape(n, n) + RIDGE * np.diag([1.0] * width + [1e-6]), sums[n * n :])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((model.raw(_matrix(batch.column("x"))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, batch.column("y").to_numpy(), BINS), np.bincount(at, minlength=BINS).astype(float)])

    found = _summed(rows.where("aside"), bins)
    if found is None:
        found = _summed(rows, bins)
    total, weight = found[:BINS], found[BINS:]
    live = np.flatnonzero(weight)
    model.knots = pool_adjacent((live + 0.5) / BINS * 2 - 0.5, total[live], weight[live])
    return model


def score(measured: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    return measured.mapInArrow(each, "doc_id long, score double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of rows that are not held out."""
    measured = materialise(features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = score(measured, fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
