import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kilowave.llm import packing as P

from .messy import DOCS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
CODER = P.WordIds(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["don't", "É.", "ñ!?", "a'b.", "Σίσυφος", "İ", "x×", "<|endoftext|>", "<|ENDOFTEXT|>", "3.5", "ﬀ", "é,", " ", "!!"]), max_size=8).map(" ".join)), max_size=4))
def test_ids_are_the_tokenizers(texts):
    for text, ids in zip(texts, CODER.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_word_tables_start_anew_when_full():
    coder = P.WordIds(PATH, most=500)
    for text in ("uno dos tres. cuatro, cinco seis siete", "ocho nueve uno dos", "uno"):
        assert np.frombuffer(next(coder.encode([text.encode()])), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins_hold_what_fits_without_gaps(lengths):
    bins, offsets = P.sum_of_squares(np.array(lengths, dtype=np.int64), 64)
    held = defaultdict(list)
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        held[b].append((o, n))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert len(held) <= -(-sum(lengths) // 64) * 2


def test_messy_documents(spark):
    docs = documents(spark)
    out = P.pack_documents(docs, cell=7).collect()
    want = defaultdict(int)
    for i, t in DOCS:
        ids = np.array(PLAIN.encode(t or "", add_special_tokens=False).ids + [P.END], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), P.SEQUENCE)):
            part = ids[lo : lo + P.SEQUENCE]
            want[(i, k, lo, len(part), zlib.crc32(part.tobytes()))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in out:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= P.SEQUENCE
    assert P.pack_documents(docs.limit(0)).count() == 0
