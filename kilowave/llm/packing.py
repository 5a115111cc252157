"""Best-fit packing: the sum-of-squares rule over token counts, in bounded cells.

Every document becomes ids (tokenizer ids, then END); longer ones are cut into pieces of the sequence length.
Pieces are placed largest first, each where the sum over residual gaps of the squared number of open bins
with that gap becomes smallest (a new bin counts as a choice; the smallest gap wins a tie). A cell of about
CELL pieces is packed at a time, so any number of cells run side by side, a task holds lengths only, and
a cell leaves few part-filled bins. Pieces are dealt to cells by a row number that is fixed in a written
table first, so repeated rows are no hot key and a lost executor changes nothing.

Words are tokenised once per worker and kept in two tables of KEPT_BYTES at most, a young one and the one before it: white
space ends a token for this vocabulary and only case-folded text is looked up, so the ids are those of the whole text.
Texts that contain `<|` go to the tokenizer whole, since control strings may be in them.

Defined cases: null and empty texts have END alone; very long texts are tokenised whole, one at a time, and cut into pieces;
repeated rows and null doc_ids are placed each on their own; of equal choices the smallest gap wins, of equal lengths the earlier row
goes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, materialise, slices

SEQUENCE, END, CELL = 4096, 1, 50_000
#: Bytes that each of a worker's two word tables and its table of stems may take, and what an entry takes beside its two texts.
KEPT_BYTES, ENTRY_BYTES = 64 << 20, 170
#: ASCII punctuation other than an apostrophe: after a letter or digit, no token spans its beginning.
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class WordIds:
    """Ids of texts, as little-endian 32-bit bytes, by tables of words and of stems."""

    def __init__(self, path: str, most: int = KEPT_BYTES):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words, self.before, self.stems = {}, {}, {}
        self.word_bytes = self.stem_bytes = 0

    def keep(self, found: dict[bytes, bytes]) -> None:
        self.words.update(found)
        self.word_bytes += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        parts, stems = [], self.stems
        for w in words:
            stem = w.rstrip(TAIL)
            n = len(stem)
            # the stem must end in a letter: ASCII, or Latin-1 other than the two signs among its letters
            if n < len(w) and n and (stem[-1] in ENDS or n > 1 and stem[-2] == 0xC3 and stem[-1] not in (0x97, 0xB7)):
                parts.append((w, stem, w[n:]))
            else:
                parts.append((w, w, b""))
        if self.stem_bytes > self.most:
            stems.clear()
            self.stem_bytes = 0
        new = [x for x in {p[1] for p in parts} | {p[2] for p in parts} if x not in stems]
        for stem, got in zip(new, self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False), strict=True):
            stems[stem] = ids = array("I", got.ids).tobytes()
            self.stem_bytes += ENTRY_BYTES + len(stem) + len(ids)
        return {w: stems[a] + stems[b] if b else stems[a] for w, a, b in parts}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [None if b"<|" in t else t.lower().split() for t in texts]
        every = set().union(*(s for s in split if s))
        if self.word_bytes > self.most:  # words in use come back from the table before
            self.words, self.before, self.word_bytes = {}, self.words, 0
        new = [w for w in every if w not in self.words]  # set - keys() would go through the whole table
        if new:
            before = self.before
            known = {w: before[w] for w in new if w in before}
            self.keep(known)
            self.keep(self.learn([w for w in new if w not in known] if known else new))
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield b"".join(map(self.words.__getitem__, words))


@cache
def _coder(path: str) -> WordIds:
    """The tables of this worker process, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def cut_pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    bounded_batches(docs.sparkSession)
    end = np.array([END], dtype="<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        gc.disable()  # the tables hold no cycles, and going through them again and again costs a fifth of the time
        try:
            for batch in slices(batches, "text"):
                doc, piece, start, length, crc = [], [], [], [], []
                texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[lo : lo + 4 * most]
                        doc.append(doc_id), piece.append(k), start.append(lo // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by the sum-of-squares rule, largest lengths first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    count = np.zeros(room + 1, dtype=np.int64)  # open bins by gap; gap 0 is closed and gap room is a bin not begun: both count nothing
    made, never = 0, 4 * len(lengths) + 4
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # a bin of gap g becomes one of gap g - s: the sum changes by 2 * (count[g - s] - count[g]) + 2
        change = 2 * (count[: room + 1 - s] - count[s:] + 1)
        if s < room:
            change[0] = 1 - 2 * count[s]  # one closes
        change[count[s:] == 0] = never
        change[-1] = 2 * count[room - s] + 1 if s < room else 0  # one begins
        g = int(np.argmin(change)) + s
        if g == room:
            b, made = made, made + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, room - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, room: int = SEQUENCE, cell: int = CELL) -> DataFrame:
    """pieces (column length, 1 to room) with sequence_id and offset."""
    fixed = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()))
    cells = -(-fixed.count() // cell) or 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def closed():
            table = pa.Table.from_batches(held)
            bins, offsets = sum_of_squares(table.column("length").to_numpy(), room)
            table = table.drop_columns(["__row", "__cell"]).append_column("sequence_id", pa.array((np.int64(key) << np.int64(32)) + bins)).append_column("offset", pa.array(offsets))
            yield from table.to_batches(max_chunksize=10_000)

        for batch in batches:
            at = batch.column("__cell").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and at[lo] != key:
                    yield from closed()
                    held = []
                key = int(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from closed()

    dealt = fixed.withColumn("__cell", F.pmod(F.xxhash64("__row"), F.lit(cells)).cast("long")).repartition(cells, "__cell").sortWithinPartitions("__cell", "__row")
    return dealt.mapInArrow(placed, ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, room: int = SEQUENCE, cell: int = CELL) -> DataFrame:
    """Every piece of every row of docs with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_pieces(docs, vocabulary, room), room, cell)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
