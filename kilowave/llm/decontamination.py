"""Benchmark decontamination: a distributed positional inverted index of the training texts.

The index is a written table of segments. A segment covers about a megabyte of documents and holds, for each
term (64-bit hash of a word), the ascending list of its positions in the segment, beside where each document begins.
Only terms that may occur in tests are posted; a bitmap of fixed size, made from the tests, tells them apart.

A query block of tests goes to every segment. Windows of WINDOW consecutive test words (a shorter test is one
window) are matched there by intersecting the offset-adjusted lists of their terms, rarest in the
segment first; a window with a term that the segment lacks costs a lookup. What is left is an exact phrase.
`proximity_matches` intersects a test's rarest terms within a distance instead.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Scale: one pass over the texts, none of them shuffled; the index goes by segment, so a frequent term is spread
over all. Tests are sent in blocks of BLOCK_BYTES of their texts, of which two at most are on the driver; more blocks are more
passes over the index, each of which writes its matches alone.

Defined cases: null texts have no words, no hits and no items; tests without words match nothing; equal item_ids
count once; tests without an item_id mark words, but are not counted as items; very long texts are a segment of their own; repeated
rows and null doc_ids each get a result; terms that are as rare go by their hash; empty tables give empty results or no hits; other
columns, whatever their names, are ignored (or kept, by drop_contaminated).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, words_of
from .common import bounded_batches, fresh, materialise, slices

WINDOW, BLOCK_BYTES = 13, 4 << 20
BITS = 1 << 22

FOUND = "segment long, place int, doc_id long, n_words long, hit_from array<int>, hit_to array<int>, items array<long>, nameless boolean"


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(42)).astype(np.int64)


def test_bitmap(tests: DataFrame) -> bytes:
    """BITS bits, set for every term of the tests; made in the tasks, joined here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in slices(batches, "text"):
            bits[_slots(words_of(batch.column("text"), ALNUM, lower=True).hashes())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                bits |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    rows = tests.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "bits binary").repartition(8).mapInArrow(joined, "bits binary").collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def build_index(docs: DataFrame, bitmap: bytes | None = None) -> DataFrame:
    """The written index: (segment, doc_ids, first, terms, starts, positions), a row a segment, arrays as little-endian bytes.

    bitmap: post only the terms it holds (default: every term). A document's words are positions first[i] up to
    first[i + 1]; the list of terms[k] is positions[starts[k]:starts[k + 1]], of which positions holds the differences.
    """
    from pyspark import TaskContext

    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool) if bitmap is not None else None
        segment = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            w = words_of(batch.column("text"), ALNUM, lower=True)
            h = w.hashes()
            at = np.flatnonzero(held[_slots(h)]) if held is not None else np.arange(len(h))
            order = np.argsort(h[at], kind="stable")
            listed, positions = h[at][order], at[order].astype(np.int32)
            starts = np.concatenate([[0], np.flatnonzero(listed[1:] != listed[:-1]) + 1]) if len(listed) else np.zeros(0, np.int64)
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid()).astype(np.uint8)
            cols = [np.asarray(ids.fill_null(0)).astype("<i8"), known, w.first.astype("<i4"), listed[starts].astype("<u8"), np.append(starts, len(listed)).astype("<i4"), np.diff(positions, prepend=np.int32(0)).astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([segment]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["segment", "doc_ids", "known", "first", "terms", "starts", "positions"])
            segment += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(each, "segment long, doc_ids binary, known binary, first binary, terms binary, starts binary, positions binary"))


class Segment:
    """One row of the index, unpacked."""

    def __init__(self, row: dict):
        take = lambda k, t: np.frombuffer(row[k], t)
        self.number, self.first, self.terms, self.starts = row["segment"], take("first", "<i4"), take("terms", "<u8"), take("starts", "<i4")
        self.positions = np.cumsum(take("positions", "<i4"), dtype=np.int32)
        self.doc_ids = [i if k else None for i, k in zip(take("doc_ids", "<i8").tolist(), take("known", np.uint8).tolist(), strict=True)]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of the terms begin and end; an absent term has an empty one."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[k] == terms
        return np.where(there, self.starts[k], 0), np.where(there, self.starts[k + 1], 0)

    def phrase(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions at which the words with lists lo[i]:hi[i] follow one another within a document."""
        order = np.argsort(hi - lo, kind="stable")
        at = self.positions[lo[order[0]] : hi[order[0]]] - order[0]
        for i in order[1:]:
            own = self.positions[lo[i] : hi[i]]
            k = np.searchsorted(own, at + i)
            at = at[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] == at + i)]
            if not len(at):
                return at
        at = at[at >= 0]
        return at[self.document(at) == self.document(at + len(lo) - 1)]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


class Tests:
    """A block of tests: distinct terms, and distinct windows of them with the items they come from."""

    def __init__(self, items: list[int | None], texts: list[str | None]):
        w = words_of(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.items, h = items, w.hashes()
        self.terms, number = np.unique(h, return_inverse=True)
        self.words = [number[w.first[i] : w.first[i + 1]] for i in range(len(items))]
        windows: dict[bytes, set[int]] = {}
        for i, own in enumerate(self.words):
            n = min(WINDOW, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                windows.setdefault(own[k : k + n].astype(np.int64).tobytes(), set()).add(i)
        self.windows = [(np.frombuffer(k, np.int64), v) for k, v in windows.items()]
        self.table = np.array([np.pad(k, (0, WINDOW - len(k)), mode="edge") for k, _ in self.windows], np.int64).reshape(len(self.windows), WINDOW)


def _blocks(tests: DataFrame) -> Iterator[Tests]:
    rows = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        own = rows.where(block == b).distinct().collect()
        yield Tests([r.item_id for r in own], [r.text for r in own])


def _segment_hits(segment: Segment, tests: Tests) -> dict[int, tuple[list, set]]:
    lo, hi = segment.lists(tests.terms)
    size = hi - lo
    found: dict[int, tuple[list, set]] = {}
    for k in np.flatnonzero((size[tests.table] > 0).all(axis=1)) if len(tests.windows) else ():
        window, items = tests.windows[k]
        at = segment.phrase(lo[window], hi[window])
        for a, d in zip(at.tolist(), segment.document(at).tolist(), strict=True):
            spans, own = found.setdefault(d, ([], set()))
            spans.append((a, a + len(window)))
            own |= items
    return found


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def phrase_matches(index: DataFrame, tests: Tests, hits_only: bool = False) -> DataFrame:
    """Every document of the index, or those with a match: its words, the merged spans of words in exact matches and the items matched (FOUND)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                hits = _segment_hits(s, tests)
                out = []
                for d, doc_id in enumerate(s.doc_ids):
                    if hits_only and d not in hits:
                        continue
                    spans, items = hits.get(d, ((), ()))
                    base, spans = int(s.first[d]), _merged(list(spans))
                    ids = {tests.items[i] for i in items}
                    out.append((s.number, d, doc_id, int(s.first[d + 1]) - base, [a - base for a, _ in spans], [b - base for _, b in spans], sorted(x for x in ids if x is not None), None in ids))
                if out:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_()]
                    names = ["segment", "place", "doc_id", "n_words", "hit_from", "hit_to", "items", "nameless"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return index.mapInArrow(each, FOUND)


def proximity_matches(index: DataFrame, tests: Tests, terms: int = 4, within: int = 40) -> DataFrame:
    """(doc_id, item_id, at): places of a test's rarest term in the segment with its next rarest terms all within so many words, in any order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, out = Segment(row), []
                lo, hi = s.lists(tests.terms)
                for item, words in zip(tests.items, tests.words, strict=True):
                    kinds = np.unique(words)
                    size = hi[kinds] - lo[kinds]
                    kinds = kinds[size > 0][np.argsort(size[size > 0], kind="stable")][:terms]
                    if len(kinds) < min(terms, len(np.unique(words))) or not len(kinds):
                        continue
                    at = s.positions[lo[kinds[0]] : hi[kinds[0]]]
                    for k in kinds[1:]:
                        own = s.positions[lo[k] : hi[k]]
                        doc = s.document(at)
                        begin = np.maximum(at - within, s.first[doc])
                        n = np.searchsorted(own, begin)
                        end = np.minimum(at + within, s.first[doc + 1] - 1)
                        at = at[(n < len(own)) & (own[np.minimum(n, len(own) - 1)] <= end)]
                    out += [(s.doc_ids[d], item, a - int(s.first[d])) for a, d in zip(at.tolist(), s.document(at).tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "at"])

    return index.mapInArrow(each, "doc_id long, item_id long, at long")


def contamination(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """Every row of docs: (doc_id, n_words, n_hit, items, contaminated)."""
    index = build_index(docs, test_bitmap(tests))
    blocks = _blocks(tests)
    one, two = next(blocks, None), next(blocks, None)
    lists = ["hit_from", "hit_to", "items"]
    if two is None:
        found = phrase_matches(index, one or Tests([], [])).select("doc_id", "n_words", *lists)
    else:  # a block at a time: its tests are here only while its matches are written
        hits = None
        for block in itertools.chain([one, two], blocks):
            own = materialise(phrase_matches(index, block, hits_only=True).select("segment", "place", *lists))
            hits = own if hits is None else hits.unionByName(own)
        joined = hits.groupBy("segment", "place").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists))
        every = phrase_matches(index, Tests([], [])).drop(*lists)
        none = {"hit_from": "array<int>", "hit_to": "array<int>", "items": "array<long>"}
        found = every.join(joined, ["segment", "place"], "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))

    spans = F.expr("array_sort(arrays_zip(hit_from, hit_to))")
    # spans may overlap between blocks: count what lies beyond the furthest end so far
    hit = F.expr("aggregate(spans, named_struct('n', 0L, 'far', 0), (s, x) -> named_struct('n', s.n + greatest(x.hit_to - greatest(x.hit_from, s.far), 0), 'far', greatest(s.far, x.hit_to)), s -> s.n)")
    out = found.withColumn("spans", spans).select("doc_id", "n_words", hit.alias("n_hit"), F.array_distinct("items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """docs without the contaminated rows (of several texts under one doc_id, those alone), all columns kept."""
    name, uid = fresh(docs, "__uid"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = docs.select(uid.alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = contamination(own, tests).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, uid).join(bad, name, "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, benchmark hits and verdict of every document."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
di AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
dw AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM di),
m AS (SELECT dw.r, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
       FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
