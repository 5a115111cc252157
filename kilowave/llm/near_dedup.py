"""SimHash near-dedup: candidate pairs by pivot distance tables, survivors verified, links closed to groups.

Fingerprint of a text: A-Z lower-cased, words split at ASCII white space, n-word shingles with repeats, joined
by one space (fewer words: the whole sequence; none: zero); a bit is 1 if set in over half the XXH64 values.

Two fingerprints are linked at RADIUS or fewer differing bits. For any reference fingerprint (pivot) p and any
set of bit positions B, |d_B(x, p) - d_B(y, p)| <= d_B(x, y). The 64 bits are cut into BANDS bands; a linked
pair agrees on BANDS - RADIUS bands at least, and on those their distances to every pivot are equal. So the
table of distances to the pivots, taken over each choice of BANDS - RADIUS bands, is an exact equi-join key;
within a bucket, pairs whose distance coordinates to the pivots over all 64 bits differ by more than RADIUS are
discarded, and the survivors are verified bit by bit. No linked pair is lost, and pairs are never listed:
a bucket gives a spanning forest of its links.

With a `similarity` (the pipeline: five-word shingles, 0.8) texts are linked by the Jaccard similarity of their shingle sets as
well. Such texts differ in five to sixteen of 64 bits, far more than RADIUS, so their candidates come from SimHashes of small
min-wise samples of the sets, which are equal for similar texts; a bucket is linked completely, and links are verified on the whole sets.

Scale: equal fingerprints collapse first; a bucket streams through one task that holds MOST_IN_BUCKET
fingerprints at most, and larger buckets are dealt out as pairs of chunks of that size.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; very long texts are read whole, one at a
time; a bit set in exactly half the values is 0; repeated rows and rows of one doc_id with several texts each keep their result row; a group's id is the smallest doc_id in it (null if
it has none); an empty table gives an empty result; other columns, whatever their names, are ignored (or kept, by drop_near_duplicates).
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import PLAIN, gram_hashes, mix, words_of
from .common import bounded_batches, connected_components, discard, fresh, materialise, slices

BANDS, RADIUS = 6, 4
#: Pivots: reference fingerprints, from a fixed seed. KEY_PIVOTS of them make the join key of a band choice.
_RNG = random.Random(20260)
PIVOTS = [_RNG.getrandbits(64) for _ in range(24)]
KEY_PIVOTS = 12
MOST_IN_BUCKET = 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def band_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """The bit masks of every choice of bands - radius bands."""
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(masks, bands - radius)]


# -- fingerprints


def simhash(text: bytes | None, words: int) -> int:
    """Fingerprint of one text in UTF-8."""
    digest = xxhash.xxh64_digest
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return int.from_bytes(digest(b" ".join(parts), 42), "big")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, n = np.zeros(64, dtype=np.int64), len(parts) - words + 1
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        hashed = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[lo:hi].tolist(), ends[lo + words - 1 : hi + words - 1].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, sets: bool = False) -> DataFrame:
    """(doc_id, fp, uid) of every row: the fingerprint as a signed long, and a hash of doc_id and text.

    sets: with (sid, n, prints), of rows with a word: a hash of the shingle set, its size and the prints of its samples.
    """
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            found = np.array([simhash(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in texts], dtype=np.uint64)
            cols = [batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("uid")]
            if sets:
                sid, n, prints = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                for k, own in _shingles(batch, words):
                    sid[k] = int(np.uint64(mix(own + np.uint64(9)).sum(dtype=np.uint64)).view(np.int64))
                    n[k], prints[k] = len(own), sample_prints(own).view(np.int64)
                cols += [pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "uid", "sid", "n", "prints"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _uid(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long, uid long" + ", sid long, n int, prints array<long>" * sets)


def _uid():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("uid")


# -- links


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within fps: (u, v) arrays.

    The groups grow one fingerprint at a time. Each compares itself with those not yet reached: first by the
    table of distances to the pivots, then, if no coordinate rules the pair out, bit by bit.
    """
    x = np.unique(fps)
    table = np.stack([_apart(x, np.uint64(p)) for p in PIVOTS]).astype(np.int8)
    left = np.arange(len(x))
    us, vs, todo, root = [], [], [], 0
    while len(left):
        if todo:
            at = todo.pop()
        else:
            root, left = left[0], left[1:]
            at = root
        where = np.arange(len(left))
        for row in table:
            where = where[np.abs(row[left[where]] - row[at]) <= radius]
            if len(where) < 64:
                break
        where = where[_apart(x[left[where]], x[at]) <= radius]
        if len(where):
            near = left[where]
            us.append(np.full(len(near), x[root]))
            vs.append(x[near])
            todo.extend(near.tolist())
            left = np.delete(left, where)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def _linked(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Positions of the pairs that no pivot rules out and that are within the radius."""
    at = np.arange(len(x))
    for p in PIVOTS:
        a, b = _apart(x[at], np.uint64(p)).astype(np.int8), _apart(y[at], np.uint64(p)).astype(np.int8)
        at = at[np.abs(a - b) <= radius]
        if len(at) < 64:
            break
    return at[_apart(x[at], y[at]) <= radius]


#: Buckets up to this size are looked through together, pair by pair, before any of them is searched on its own.
SMALL = 16


def _links_of(fp: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the buckets fp[cuts[i]:cuts[i + 1]]."""
    size = np.diff(cuts)
    bucket = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(fp)) - cuts[:-1][bucket]
    room = size[bucket]
    found = [np.flatnonzero(size > SMALL)]
    for lag in range(1, SMALL):
        at = np.flatnonzero((room <= SMALL) & (place + lag < room))
        if not len(at):
            break
        at = at[_linked(fp[at], fp[at + lag])]
        two = at[room[at] == 2]
        if len(two):
            yield fp[two], fp[two + 1]
        found.append(bucket[at[room[at] > 2]])
    for i in np.unique(np.concatenate(found)).tolist():
        u, v = bucket_links(fp[cuts[i] : cuts[i + 1]])
        if len(u):
            yield u, v


def _link_stream(most: int):
    """Buckets sorted by key, in one pass: links of the small ones (chunk -1), and the members of the others with their chunk."""

    def table(u, v, chunk=-1, band=0, vec=0):
        n = len(u)
        cols = [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(n, chunk, np.int32)), pa.array(np.full(n, band, np.int32)), pa.array(np.full(n, vec, np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["u", "v", "chunk", "band", "vec"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, vec, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot, chunk = None, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                band = np.concatenate([band, batch.column("band").to_numpy()])
                vec = np.concatenate([vec, batch.column("vec").to_numpy()])
                fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(fp):
                continue
            cuts = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (vec[1:] != vec[:-1])) + 1, [len(fp)]])
            if hot is not None and (len(cuts) > 2 or batch is None):  # the large bucket has ended
                end = cuts[1] if (int(band[0]), int(vec[0])) == hot else 0
                if end:
                    yield table(fp[:end], fp[:end], chunk, *hot)
                cuts, hot, chunk = cuts[cuts >= end], None, 0
            last = cuts[-1] if batch is None else cuts[-2]
            whole = cuts[cuts <= last]
            if len(whole) > 1:
                base = whole[0]
                for u, v in _links_of(fp[base:last], whole - base):
                    yield table(u, v)
            band, vec, fp = band[last:], vec[last:], fp[last:]
            while len(fp) > most:
                hot = (int(band[0]), int(vec[0]))
                yield table(fp[:most], fp[:most], chunk, *hot)
                band, vec, fp, chunk = band[most:], vec[most:], fp[most:], chunk + 1

    return each


def _pair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of chunks, sorted by pair: the links within and between both."""
    key, held = None, []

    def closed():
        u, v = bucket_links(np.concatenate(held))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("band", "vec", "i", "j")), strict=True))
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for at, k in enumerate(rows):
            if k != key:
                if key is not None:
                    yield from closed()
                key, held = k, []
            held.append(fp[at : at + 1])
    if key is not None:
        yield from closed()


def fingerprint_links(fps: DataFrame, bands: int = BANDS, most: int = MOST_IN_BUCKET, made: list[DataFrame] | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints of column fp whose closure is the closure of all links. made: gets the tables it reads."""
    choices = []
    for i, mask in enumerate(band_masks(bands)):
        vector = " | ".join(f"shiftleft(cast(bit_count((fp ^ {_signed(p)}L) & {_signed(mask)}L) as bigint), {5 * k})" for k, p in enumerate(PIVOTS[:KEY_PIVOTS]))
        choices.append(f"named_struct('band', {i}, 'vec', {vector})")
    keyed = fps.select("fp", F.expr(f"inline(array({', '.join(choices)}))"))
    dealt = keyed.repartition(F.col("band"), F.col("vec")).sortWithinPartitions("band", "vec")
    links = materialise(dealt.mapInArrow(_link_stream(most), "u long, v long, chunk int, band int, vec long"), made)
    plain = links.where("chunk < 0").select("u", "v")
    hot = links.where("chunk >= 0").select("band", "vec", "chunk", F.col("u").alias("fp"))
    last = hot.groupBy("band", "vec").agg(F.max("chunk").alias("last"))
    if last.isEmpty():
        return plain
    # chunk c meets every later and earlier chunk once: pair (i, j) holds chunks i and j
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    pairs = hot.join(last, ["band", "vec"]).select("band", "vec", "fp", "chunk", other).select("band", "vec", "fp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    dealt = pairs.repartition("band", "vec", "i", "j").sortWithinPartitions("band", "vec", "i", "j")
    return plain.unionByName(dealt.mapInArrow(_pair_stream, "u long, v long"))


# -- similarity of shingle sets


#: Samples of a shingle set, and shingles in each.
SAMPLES, SAMPLE_SIZE = 16, 3
#: Buckets of equal sample prints up to this size list their pairs; larger ones are dealt out in chunks of so many shingles.
FEW, CHUNK_SHINGLES = 6, 1 << 20
_ODD = np.array([random.Random(77 + k).getrandbits(64) | 1 for k in range(SAMPLES)], dtype=np.uint64)


def sample_prints(shingles: np.ndarray) -> np.ndarray:
    """A SimHash of each sample of a set of hashed shingles: the bitwise majority of the three that are least under a keyed order."""
    least = []
    for odd in _ODD:
        own = mix(shingles * odd)
        least.append(np.partition(own, SAMPLE_SIZE - 1)[:SAMPLE_SIZE] if len(own) > SAMPLE_SIZE else np.sort(own))
    out = []
    for x in least:
        bits = (x[0] & x[1]) | (x[0] & x[2]) | (x[1] & x[2]) if len(x) == 3 else x[0] & x[1] if len(x) == 2 else x[0]
        out.append(bits)
    return mix(np.array(out, dtype=np.uint64) + np.arange(SAMPLES, dtype=np.uint64))


def _shingles(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted set of hashed shingles) of every row with a word."""
    w = words_of(batch.column("text"), PLAIN, lower=True)
    h = w.hashes()
    g = gram_hashes(h, words)
    for k, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if lo < hi:
            yield k, np.unique(g[lo : hi - words + 1] if hi - lo >= words else gram_hashes(h[lo:hi], hi - lo))


def _whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, n, own) of the wanted sets: all their shingles, from one text each."""
    named = sets.join(wanted, "sid").groupBy("sid").agg(F.min("uid").alias("uid"))
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_shingles(batch, words))
            if found:
                sid = batch.column("sid").take(pa.array([k for k, _ in found]))
                yield pa.RecordBatch.from_arrays([sid, pa.array([len(x) for _, x in found], pa.int32()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["sid", "n", "own"])

    texts = docs.select(_uid(), F.col("text").cast("string").alias("text")).join(named, "uid").select("sid", "text")
    return texts.mapInArrow(each, "sid long, n int, own binary").groupBy("sid").agg(F.first("n").alias("n"), F.first("own").alias("own"))


def _buckets(similarity: float, few: int, room: int):
    """Rows sorted by print and n: all pairs of the small buckets that sizes allow (chunk -1), and the members of the others with their chunk."""

    def table(u, v, key, n, chunk):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(key), pa.array(n.astype(np.int32)), pa.array(chunk.astype(np.int32))], ["u", "v", "print", "n", "chunk"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sid, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot, carried = None, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key, sid, n = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((key, "print"), (sid, "sid"), (n, "n")))
            if not len(key):
                continue
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(first, append=len(key))
            big = size > few
            big[0] |= hot is not None and key[0] == hot
            listed = ~big
            if batch is not None:
                listed[-1] = False  # it may go on
            bucket = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(key)) - first[bucket]
            for lag in range(1, few):
                at = np.flatnonzero(listed[bucket] & (place + lag < size[bucket]))
                at = at[n[at] + 1e-9 >= similarity * n[at + lag]]
                if len(at):
                    yield table(np.maximum(sid[at], sid[at + lag]), np.minimum(sid[at], sid[at + lag]), np.zeros(len(at), np.int64), np.zeros(len(at)), np.full(len(at), -1))
            before = np.cumsum(n) - n
            before -= before[first][bucket]
            if big[0] and hot is not None and key[0] == hot:
                before[: size[0]] += carried
            at = np.flatnonzero(big[bucket])
            if len(at):
                yield table(sid[at], sid[at], key[at], n[at], before[at] // room)
            hot, carried = (int(key[-1]), int(before[-1] + n[-1])) if big[-1] else (None, 0)
            last = len(key) if big[-1] or batch is None else first[-1]
            key, sid, n = key[last:], sid[last:], n[last:]

    return each


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within sets, as two arrays of their places.

    The groups grow one set at a time. Two sets so similar share one of the rarest (1 - similarity) n + 1 shingles of either, so a set
    is compared only with those not yet reached that do; all are verified.
    """
    n = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.cumsum(n) - n
    order = np.lexsort((token, count[token], of))
    rare = order[(np.arange(len(of)) - first[of]) < (n - np.ceil(similarity * n - 1e-9) + 1)[of]]
    rare_first = np.searchsorted(of[rare], np.arange(len(sets) + 1))
    rare_token = token[rare]
    by = np.argsort(rare_token, kind="stable")
    key, holder = rare_token[by], of[rare][by]
    reached, mark, left = np.zeros(len(sets), bool), np.zeros(len(count), bool), len(sets)
    us, vs, todo = [], [], []
    for root in range(len(sets)):
        if reached[root]:
            continue
        reached[root], left = True, left - 1
        todo.append(root)
        while todo and left:
            at = todo.pop()
            if 2 * left < len(holder) and left < 64:
                near = np.flatnonzero(~reached)
            else:
                mine = rare_token[rare_first[at] : rare_first[at + 1]]
                lo, hi = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
                near = [holder[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
                if not near:
                    continue
                near = np.unique(np.concatenate(near))
                near = near[~reached[near]]
            near = near[np.minimum(n[near], n[at]) + 1e-9 >= similarity * np.maximum(n[near], n[at])]
            if not len(near):
                continue
            own = token[first[at] : first[at] + n[at]]
            mark[own] = True
            size = n[near]
            starts = np.cumsum(size) - size
            common = np.add.reduceat(mark[token[np.arange(size.sum()) + np.repeat(first[near] - starts, size)]], starts, dtype=np.int64)
            mark[own] = False
            near = near[common + 1e-9 >= similarity * (n[at] + size - common)]
            if len(near):
                us.append(np.full(len(near), root)), vs.append(near)
                reached[near] = True
                left -= len(near)
                todo.extend(near.tolist())
                if 4 * len(near) > left:
                    keep = ~reached[holder]
                    key, holder = key[keep], holder[keep]
        todo.clear()
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _bucket_stream(similarity: float):
    """Sets sorted by bucket and pair of chunks: the links within and between both."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sids, held = None, [], []

        def closed():
            u, v = set_links(held, similarity)
            if len(u):
                named = np.array(sids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(named[u]), pa.array(named[v])], ["u", "v"])

        for batch in batches:
            for *k, sid, own in zip(*(batch.column(c).to_pylist() for c in ("print", "i", "j", "sid", "own")), strict=True):
                if k != key:
                    if key is not None:
                        yield from closed()
                    key, sids, held = k, [], []
                sids.append(sid), held.append(np.frombuffer(own, np.uint64))
        if key is not None:
            yield from closed()

    return each


def similar_sets(docs: DataFrame, sets: DataFrame, words: int, similarity: float, few: int = FEW, room: int = CHUNK_SHINGLES, made: list[DataFrame] | None = None) -> DataFrame:
    """(u, v): links of different shingle sets, by sid, whose closure is that of all pairs that share a bucket and have a Jaccard similarity of at least so much.

    Sets that agree on a sample's fingerprint share a bucket (sets of similarity s miss all samples with odds of about (1 - s**3)**16). Buckets of
    up to FEW sets list their pairs; a larger one gets the sets themselves and gives a spanning forest, in pairs of chunks that may hold similar
    sizes. Every link is verified on the whole sets.
    """
    rows = sets.select("sid", "n", F.explode("prints").alias("print")).distinct()
    dealt = rows.repartition("print").sortWithinPartitions("print", "n", "sid")
    dealt = materialise(dealt.mapInArrow(_buckets(similarity, few, room), "u long, v long, print long, n int, chunk int"), made)
    wanted = dealt.select(F.col("u").alias("sid")).unionByName(dealt.select(F.col("v").alias("sid"))).distinct()
    own = materialise(_whole_sets(docs, sets, wanted, words), made)
    pairs = dealt.where("chunk < 0").select("u", "v").distinct()
    both = pairs.join(own.select(F.col("sid").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("sid").alias("v"), F.col("own").alias("b")), "v")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common + 1e-9 >= similarity * (len(x) + len(y) - common))
            out = batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    plain = both.select("u", "v", "a", "b").mapInArrow(verified, "u long, v long")
    hot = dealt.where("chunk >= 0").select("print", "chunk", F.col("u").alias("sid"), "n")
    if hot.isEmpty():
        return plain
    spans = hot.groupBy("print", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    later = spans.select("print", F.col("chunk").alias("j"), F.col("least").alias("next"))
    cells = spans.withColumnRenamed("chunk", "i").join(later, "print").where((F.col("i") <= F.col("j")) & (F.col("most") + 1e-9 >= F.lit(similarity) * F.col("next")))
    cells = cells.select("print", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    members = hot.select("print", "chunk", "sid").join(cells, ["print", "chunk"]).join(own.select("sid", "own"), "sid").select("print", "i", "j", "sid", "own")
    dealt = members.repartition("print", "i", "j").sortWithinPartitions("print", "i", "j")
    return plain.unionByName(dealt.mapInArrow(_bucket_stream(similarity), "u long, v long"))


def _set_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float, made: list[DataFrame]) -> DataFrame:
    """(u, v): the links of similar shingle sets, as links of fingerprints. prints: with sets."""
    sets = prints.where("sid is not null")
    named = materialise(sets.select("sid", "fp").distinct(), made)
    first = named.groupBy("sid").agg(F.min("fp").alias("first"))
    inner = named.join(first, "sid").where("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    pairs = similar_sets(docs, sets, words, similarity, made=made)
    outer = pairs.join(first.select(F.col("sid").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("sid").alias("v"), F.col("first").alias("y")), "v")
    return inner.unionByName(outer.select(F.col("x").alias("u"), F.col("y").alias("v")))


def near_duplicates(docs: DataFrame, words: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, uid, root, component_id) of every row: its fingerprint, its group and the smallest doc_id in it.

    similarity: also link texts whose sets of shingles have at least this Jaccard similarity, which may lie further apart than RADIUS bits.
    """
    made: list[DataFrame] = []
    if similarity is None:
        full = prints = materialise(fingerprints(docs, words))
    else:
        full = materialise(fingerprints(docs, words, sets=True), made)
        prints = materialise(full.select("doc_id", "fp", "uid"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(distinct.select("fp"), made=made)
    if similarity is not None:
        links = links.unionByName(_set_links(docs, full, words, similarity, made))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    discard(*made)
    grouped = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "uid", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id (of several texts under it, any one)."""
    groups = near_duplicates(docs, words, similarity)
    name = fresh(docs, "__uid")
    first = groups.where("doc_id <=> component_id").groupBy("root").agg(F.min("uid").alias(name)).select(name)
    kept = docs.withColumn(name, _uid()).join(first, name, "left_semi")
    return kept.dropDuplicates([name, "doc_id"]).select(*docs.columns)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
