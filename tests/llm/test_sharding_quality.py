import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilowave.llm import quality_rules, sharding

from .messy import DOCS, documents


def test_shards_are_even_gapless_and_repeatable(spark):
    docs = documents(spark)
    a = sharding.shard_documents(docs, 3).collect()
    assert Counter(a) == Counter(sharding.shard_documents(docs.repartition(7), 3).collect())
    assert sorted(r.position for r in a) == list(range(len(DOCS)))
    for s in range(3):
        slots = sorted(r.slot for r in a if r.shard == s)
        assert slots == list(range(len(slots)))
    want = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in a) == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 101])
def test_every_size_is_a_permutation(spark, n):
    rows = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text")
    assert sorted(r.position for r in sharding.shard_documents(rows).collect()) == list(range(n))


def test_one_row_repeated_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 64)  # several runs
    rows = spark.range(900).selectExpr("7 as doc_id", "'same' as text")
    out = sharding.shard_documents(rows).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [112] * 4 + [113] * 4


def test_empty_tables(spark):
    assert sharding.shard_documents(documents(spark).limit(0)).count() == 0
    assert quality_rules.quality_report(documents(spark).limit(0)).count() == 0
    assert quality_rules.keep_good(documents(spark).limit(0)).columns == documents(spark).columns


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def covered(n):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        many = Counter(grams)
        return {p for k, g in enumerate(grams) if many[g] > 1 for p in range(k, k + n)}

    chars = sum(map(len, words))
    seen, dup, dup_chars, all_chars = set(), 0, 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            all_chars += len(line)
            dup += line in seen
            dup_chars += len(line) * (line in seen)
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered(5)) > 20 * len(words)
    shares = [sum(len(words[p]) for p in covered(n)) / max(chars, 1) for n in sorted(quality_rules.GRAMS)]
    kept = not failed and all(s <= quality_rules.GRAMS[n] for s, n in zip(shares, sorted(quality_rules.GRAMS), strict=True)) and dup_chars / max(all_chars, 1) <= quality_rules.MOST_IN_LINES
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered(5)), failed, kept


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t #|", max_size=120), st.lists(st.sampled_from(["x", "yy", "zß", "\n"]), max_size=60).map(" ".join)), max_size=6))
def test_measures_match_brute_force(texts):
    got = quality_rules.measure(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert tuple(got[f][k] for f in FIELDS) == by_hand(t)


def test_report_and_filter_agree(spark):
    docs = documents(spark)
    report = {(r.doc_id, r.n_words, r.kept) for r in quality_rules.quality_report(docs).collect()}
    assert report == {(d[0], by_hand(d[1])[0], by_hand(d[1])[6]) for d in DOCS}
    kept = quality_rules.keep_good(docs)
    assert kept.dtypes == docs.dtypes
    assert Counter(r.text for r in kept.collect()) == Counter(d[1] for d in DOCS if by_hand(d[1])[6])
