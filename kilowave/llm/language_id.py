"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Training: a sample of at most PER_LANGUAGE rows of each language and MOST_ROWS in all (the rows with the
smallest hash of doc_id and text; one stretch of SNIPPET characters of each), Adam on the cross-entropy of every
position, gradients by backpropagation through time. Prediction: every byte of every text; texts are cut into
windows of WINDOW bytes that run side by side, each position gets log-probabilities, and a document's are
the mean over its positions. One pass, no shuffle; a worker holds a slice of about a megabyte.

Held-out rows (crc32 of doc_id as text, modulo 3, is 1) never train; lang, source and doc_id are no inputs.

Defined cases: null texts and texts without a letter give `und` with score 0, as all do if nothing can be
learned; null lang rows don't train; languages that are as likely: the first by name; very long texts are read whole, a slice of their
own; repeated rows each get a result; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import column_bytes
from .common import bounded_batches, slices

PER_LANGUAGE, MOST_ROWS, SNIPPET = 300, 20_000, 400
HIDDEN, WINDOW, CROP, BATCH, STEPS, RATE = 12, 128, 80, 64, 260, 0.02
ASCII_LETTER = re.compile(rb"[A-Za-z]")
NAMES = ("Wz", "Wr", "Wc", "Uz", "Ur", "Uc")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteGRU:
    """Two gated recurrent layers, one each way, and a softmax at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {}
        for way in "fb":
            for k in NAMES:
                rows = 256 if k[0] == "W" else hidden
                self.p[way + k] = (rng.standard_normal((rows, hidden)) * (0.3 if k[0] == "W" else 1 / np.sqrt(hidden))).astype(np.float32)
        self.p["V"] = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.p["b"] = np.zeros(len(languages), np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte, (steps, rows, hidden); keep gets what the gradient needs."""
        Wz, Wr, Wc, Uz, Ur, Uc = (self.p[way + k] for k in NAMES)
        n, steps = x.shape
        out = np.empty((steps, n, self.hidden), np.float32)
        h = np.zeros((n, self.hidden), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            at = x[:, t]
            z = _sigmoid(Wz.take(at, axis=0) + h @ Uz)
            if not mask[t].all():
                z *= mask[t][:, None]
            r = _sigmoid(Wr.take(at, axis=0) + h @ Ur)
            q = h @ Uc
            c = np.tanh(Wc.take(at, axis=0) + r * q)
            if keep is not None:
                keep.append((t, h, z, r, q, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def log_probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of every position: (steps, rows, languages)."""
        V, a = self.p["V"], self.hidden
        y = self._run("f", x, mask) @ V[:a]
        y += self._run("b", x, mask) @ V[a:]
        y += self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients."""
        keep = {"f": [], "b": []}
        states = {w: self._run(w, x, mask, keep[w]) for w in "fb"}
        V, a, total = self.p["V"], self.hidden, max(mask.sum(), 1)
        both = np.concatenate([states["f"], states["b"]], axis=2)
        y = both @ V + self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        prob = np.exp(y)
        prob /= prob.sum(axis=2, keepdims=True)
        rows = np.arange(x.shape[0])
        loss = float(-(np.log(prob[:, rows, target] + 1e-9) * mask).sum() / total)
        d = prob
        d[:, rows, target] -= 1
        d *= mask[:, :, None] / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"] = np.einsum("tnh,tnl->hl", both, d, optimize=True)
        g["b"] = d.sum(axis=(0, 1))
        dstate = d @ V.T
        for way, lo in (("f", 0), ("b", a)):
            Uz, Ur, Uc = (self.p[way + k] for k in NAMES[3:])
            dh = np.zeros((x.shape[0], a), np.float32)
            seen, grads = [], {"z": [], "r": [], "c": []}
            for t, h, z, r, q, c in reversed(keep[way]):
                dh = dh + dstate[t][:, lo : lo + a]
                dac = dh * z * (1 - c * c)
                daz = dh * (c - h) * z * (1 - z)
                dar = dac * q * r * (1 - r)
                dq = dac * r
                g[way + "Uz"] += h.T @ daz
                g[way + "Ur"] += h.T @ dar
                g[way + "Uc"] += h.T @ dq
                dh = dh * (1 - z) + daz @ Uz.T + dar @ Ur.T + dq @ Uc.T
                seen.append(x[:, t])
                for k, v in (("z", daz), ("r", dar), ("c", dac)):
                    grads[k].append(v)
            at = np.concatenate(seen)
            for k, v in grads.items():
                v = np.concatenate(v)
                for j in range(a):
                    g[way + "W" + k][:, j] = np.bincount(at, v[:, j], minlength=256)
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam on random stretches of the texts, languages in equal shares."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == k and t] for k in range(len(self.languages))]
        m, v, losses = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2)), None, []
        m, v = m
        live = [k for k, own in enumerate(by) if own]
        for step in range(1, steps + 1):
            target = np.array([live[i % len(live)] for i in range(BATCH)])
            x, mask = np.zeros((BATCH, CROP), np.int64), np.zeros((CROP, BATCH), np.float32)
            for i, k in enumerate(target):
                t = by[k][rng.integers(len(by[k]))]
                lo = int(rng.integers(max(len(t) - CROP, 0) + 1))
                part = np.frombuffer(t[lo : lo + CROP], np.uint8)
                x[i, : len(part)], mask[: len(part), i] = part, 1
            loss, g = self.gradients(x, mask, target)
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
            for k, q in g.items():
                q = q * min(1, 1 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def pooled(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Probabilities of each text, from the mean log-probability of its bytes: (texts, languages)."""
        sizes = np.diff(texts)
        windows = -(-sizes // WINDOW)
        of = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = texts[:-1][of] + place * WINDOW
        size = np.minimum(texts[1:][of] - start, WINDOW)
        total = np.zeros((len(sizes), len(self.languages)))
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 1024):
            rows = order[lo : lo + 1024]
            width = int(size[rows].max())
            x = padded[start[rows][:, None] + np.arange(width)].astype(np.intp)
            mask = (np.arange(width)[:, None] < size[rows]).astype(np.float32)
            y = self.log_probabilities(x, mask)
            np.add.at(total, of[rows], np.einsum("tnl,tn->nl", y, mask))
        mean = total / np.maximum(sizes, 1)[:, None]
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id="doc_id"):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary")) % 3) == 1


def train(docs: DataFrame) -> ByteGRU | None:
    """A network from the sample of labelled rows, or None if there are none."""
    text = F.col("text").cast("string")
    h = F.xxhash64(F.col("doc_id").cast("long"), text)
    room = F.greatest(F.length(text) - SNIPPET, F.lit(0)) + 1
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length(text) > 0)).select(F.col("lang").cast("string").alias("lang"), h.alias("h"), text.substr(F.pmod(h, room).cast("int") + 1, F.lit(SNIPPET)).alias("t"))
    # first within 32 parts of a language, so that a frequent one is ranked by 32 tasks and the last ranking sees a bounded number
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy("h"))
    few = rows.withColumn("n", part).where(F.col("n") <= PER_LANGUAGE).drop("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = few.withColumn("n", rank).where(F.col("n") <= PER_LANGUAGE).orderBy("n", "lang").limit(MOST_ROWS).collect()
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    net = ByteGRU(languages)
    if len(languages) > 1:
        net.fit([r.t.encode() for r in sample], [languages.index(r.lang) for r in sample])
    return net


def identify(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            lettered = np.array([t is not None and bool(ASCII_LETTER.search(t) or any(c.isalpha() for c in t.decode())) for t in texts], bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if net and lettered.any():
                data, at = column_bytes(batch.column("text").filter(pa.array(lettered)))
                prob = net.pooled(data, at)
                best = prob.argmax(axis=1)
                lang[lettered] = np.array(net.languages, object)[best]
                score[lettered] = prob[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
