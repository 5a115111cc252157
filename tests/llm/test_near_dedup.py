import random
import re

import numpy as np
import xxhash

from kilowave.llm import near_dedup as N
from kilowave.llm.common import connected_components

from .messy import DOCS, documents, prose


def by_hand(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_fingerprints_match_definition():
    for text in (None, "", " ", "a", "A b C", "a b c d", "É Uno dos tres cuatro", prose(300, 4), "x " * 50):
        assert N.simhash(None if text is None else text.encode(), 4) == by_hand(text)


def closure(fps, radius=4):
    fps = sorted(set(fps))
    group = {f: f for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                group[root(b)] = root(a)
    return {f: root(f) for f in fps}


def planted(n, seed):
    r = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        f = r.getrandbits(64)
        out.append(f)
        for _ in range(r.randint(0, 6)):  # chains of near ones
            for b in r.sample(range(64), r.randint(0, 5)):
                f ^= 1 << b
            out.append(f)
    return out


def partition(pairs, nodes):
    group = {x: x for x in nodes}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        group[root(b)] = root(a)
    found = {}
    for x in nodes:
        found.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, found.values()))


def test_bucket_links_close_to_all_links():
    for seed in range(20):
        fps = planted(60, seed)
        u, v = N.bucket_links(np.array(fps, dtype=np.uint64))
        want = {}
        for f, r in closure(fps).items():
            want.setdefault(r, set()).add(f)
        assert partition(zip(u.tolist(), v.tolist(), strict=True), set(fps)) == sorted(map(sorted, want.values()))
        assert len(u) < len(set(fps))


def test_links_over_small_and_large_buckets(spark):
    fps = planted(400, 99)
    base = random.Random(5).getrandbits(64)
    fps += [base ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(b)]  # one crowded bucket
    table = spark.createDataFrame([(N._signed(f),) for f in set(fps)], "fp long")
    want = {}
    for f, r in closure(fps).items():
        want.setdefault(r, set()).add(f)
    for most in (4096, 40):
        links = [(r.u % 2**64, r.v % 2**64) for r in N.fingerprint_links(table, most=most).collect()]
        assert partition(links, set(fps)) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_messy_documents(spark):
    docs = documents(spark)
    out = N.near_duplicates(docs).collect()
    assert len(out) == len(DOCS)
    prints = [by_hand(t) for _, t in DOCS]
    roots = closure(prints)
    for r in out:
        ids = [i for (i, _), f in zip(DOCS, prints, strict=True) if roots[f] == roots[r.fp % 2**64] and i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = N.drop_near_duplicates(docs, 4, None)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == len(set(roots.values()))
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, 13}
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.drop_near_duplicates(docs.limit(0)).count() == 0


def test_similar_texts_are_linked_and_others_left(spark):
    r = random.Random(8)
    texts = [prose(r.choice([8, 60, 150, 900]), 100 + k) for k in range(30)]
    for k in range(30):
        words = texts[k].split()
        for share in (0.01, 0.02, 0.05, 0.2):
            own = list(words)
            for at in r.sample(range(len(own)), max(1, int(share * len(own)))):
                own[at] = "otra"
            texts.append(" ".join(own))
    texts += ["uno dos", "uno dos", "uno tres", "", texts[3].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or (by_hand(texts[a], 5) ^ by_hand(texts[b], 5)).bit_count() <= 4:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    want = {root(a) for a in range(len(sets))}
    got = {r.doc_id for r in N.drop_near_duplicates(docs).collect()}
    assert got == want


def test_set_links_close_to_all_links():
    for seed in range(6):
        r = np.random.default_rng(seed)
        sets = []
        for _ in range(12):
            base = r.integers(0, 1 << 62, r.integers(1, 80), dtype=np.uint64)
            for _ in range(r.integers(1, 30)):
                own = base.copy()
                at = r.integers(0, len(own), r.integers(0, len(own) // 6 + 1))
                own[at] = r.integers(0, 1 << 62, len(at), dtype=np.uint64)
                sets.append(np.unique(np.concatenate([own, np.arange(9, dtype=np.uint64)])))
        plain = [set(x.tolist()) for x in sets]
        links = [(a, b) for a, x in enumerate(plain) for b, y in enumerate(plain[:a]) if 10 * len(x & y) >= 8 * len(x | y)]
        u, v = N.set_links(sets, 0.8)
        assert partition(zip(u.tolist(), v.tolist(), strict=True), range(len(sets))) == partition(links, range(len(sets)))
        assert len(u) < len(sets)


def test_every_copy_of_a_large_group_is_linked(spark):
    text = prose(300, 40).split()
    rows = [(0, " ".join(text))]
    for k in range(1, 120):  # each changed in places of its own: similar to the original, less so to each other
        own = list(text)
        for at in random.Random(k).sample(range(5, 295, 6), 6):
            own[at] = f"otra{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in N.drop_near_duplicates(docs).collect()] == [0]
    sets = N.fingerprints(docs, 5, sets=True).where("sid is not null").cache()
    for few, room in ((6, 1 << 20), (200, 1 << 20), (6, 3000)):  # forests, all pairs, pairs of chunks
        links = N.similar_sets(docs, sets, 5, 0.8, few, room).collect()
        assert len(partition([(r.u, r.v) for r in links], [r.sid for r in sets.collect()])) == 1


def test_similarity_of_long_texts_is_exact(spark):
    r = random.Random(4)
    rows = []
    for k in range(12):
        text = [f"w{k}x{n}" for n in range(3000)]
        own = list(text)
        for at in range(2, 3000, 46 if k % 2 else 44):  # a similarity of 0.804, or of 0.795
            own[at] = f"otra{r.random()}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(2996)} for i, t in rows}
    want = {i for i in sets if i % 2 == 0 or 10 * len(sets[i] & sets[i - 1]) < 8 * len(sets[i] | sets[i - 1])}
    assert len(want) == 18
    assert {r.doc_id for r in N.drop_near_duplicates(docs).collect()} == want
