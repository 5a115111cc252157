import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from kilowave.llm import chat, decontamination, html_extraction, language_id, passages, quality_model
from kilowave.llm.decontamination import OP8_SQL

from .messy import BASE, DOCS, PASSAGE, documents, prose

# -- passages


def test_a_passage_is_found_and_cut_once(spark):
    changed = PASSAGE.split()
    changed[35] = "otra"
    rows = [(1, prose(50, 1) + " " + PASSAGE + " " + prose(50, 2)), (2, prose(80, 3) + " " + " ".join(changed) + " " + prose(20, 4)), (3, prose(200, 5)), (4, PASSAGE), (5, prose(30, 6) + " " + " ".join(PASSAGE.split()[:30]) + " " + prose(90, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.from_word, r.to_word) for r in passages.repeated_passages(docs).collect()}
    assert found == {(2, 80, 150), (4, 0, 70)}
    texts = {r.doc_id: r.text for r in passages.cut_passages(docs).collect()}
    assert texts[1] == rows[0][1] and texts[3] == rows[2][1] and texts[5] == rows[4][1]
    assert texts[4] == "" and texts[2].split() == prose(80, 3).split() + prose(20, 4).split()


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def held(spark, texts):
    """Places of words in passages, by document, that repeated_passages finds; all are held by the source as well where exact."""
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in passages.repeated_passages(docs).collect():
        assert r.source_doc_id < r.doc_id
        if r.similarity == 1:
            assert texts[r.doc_id][r.from_word : r.to_word] == texts[r.source_doc_id][r.source_from : r.source_to]
        found.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    return found


def exact(texts, least=50):
    """Brute force: places of words in exact runs that an earlier document has."""
    found, seen = {}, set()
    for i, t in enumerate(texts):
        grams = [tuple(t[k : k + least]) for k in range(len(t) - least + 1)]
        for k, g in enumerate(grams):
            if g in seen:
                found.setdefault(i, set()).update(range(k, k + least))
        seen.update(grams)
    return found


def test_an_exact_passage_is_found_behind_documents_with_parts_of_it(spark):
    texts = []
    for c in range(8):
        p = words(f"p{c}x", 60)
        texts.append(words(f"a{c}x", 40) + p + words(f"b{c}x", 30))
        texts += [words(f"c{c}x{n}y", 30) + p[n * 2 : n * 2 + 40] + words(f"d{c}x{n}y", 30) for n in range(10)]
        texts.append(words(f"e{c}x", 45) + p + words(f"f{c}x", 20))
    want = exact(texts)
    assert len(want) == 8
    got = held(spark, texts)
    assert all(places <= got.get(i, set()) for i, places in want.items())


def test_fenwick_chains_match_brute_force():
    r = random.Random(1)
    for _ in range(40):
        m = sorted({(r.randrange(30), r.randrange(30)) for _ in range(r.randint(1, 9))})
        i, j = (np.array(x) for x in zip(*m, strict=True))

        def value(path):
            return passages.WEIGHT * len(path) - passages.GAP_COST * sum(b[0] - a[0] + b[1] - a[1] for a, b in itertools.pairwise(path))

        best = max(value(p) for n in range(1, len(m) + 1) for p in itertools.combinations(m, n) if all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(p)))
        got = passages.chains(i, j)
        assert sorted(p for x, y in got for p in zip(x, y, strict=True)) == m
        assert max(value(list(zip(x, y, strict=True))) for x, y in got) == pytest.approx(best)


def test_any_long_run_has_a_gram():
    r = np.random.default_rng(0)
    g = r.integers(0, 1 << 62, 5000, dtype=np.uint64)
    at = passages.smallest(g, passages.GAP)
    assert at.tolist() == [k + int(g[k : k + passages.GAP].argmin()) for k in range(len(g) - passages.GAP + 1)]


def test_passages_of_messy_documents(spark):
    docs = documents(spark)
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert {2, 3, 4, 7} <= found and not found & {1, 5, 6, 8, 9, 10, 12, 13}
    out = passages.cut_passages(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(DOCS)
    assert passages.cut_passages(docs.limit(0)).count() == 0


# -- decontamination


def duck(spark, docs, tests):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toArrow())
    c.register("benchmark", tests.select("item_id", "text").toArrow())
    return sorted(map(str, c.sql(OP8_SQL).fetchall()))


def result(docs, tests):
    from pyspark.sql import functions as F

    out = decontamination.contamination(docs, tests)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(names.cast("binary"), 256), "contaminated")


def test_phrases_match_sql(spark, monkeypatch):
    docs = documents(spark)
    items = [(1, PASSAGE), (2, "  ".join(BASE.split()[20:40])), (2, "uno DOS"), (3, None), (4, ""), (None, " ".join(BASE.split()[:15])), (5, "UNO"), (6, "é ñ"), (10, PASSAGE), (7, "no word of it")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = duck(spark, docs, tests)
    assert sorted(str(tuple(r)) for r in result(docs, tests).collect()) == want
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)  # several blocks of tests
    assert sorted(str(tuple(r)) for r in result(docs, tests).collect()) == want
    kept = decontamination.drop_contaminated(docs, tests)
    assert kept.dtypes == docs.dtypes
    bad = [eval(x) for x in want]
    assert kept.count() == sum(not b[5] for b in bad)
    none = tests.limit(0)
    assert result(docs, none).where("n_hit > 0").count() == 0 and result(docs.limit(0), tests).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta uno dos tres alfa cuatro beta"), (2, "alfa " + "x " * 100 + "beta zeta")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "beta alfa zeta")], "item_id long, text string")
    index = decontamination.build_index(docs)
    block = next(decontamination._blocks(tests))
    assert {(r.doc_id, r.item_id) for r in decontamination.proximity_matches(index, block, terms=3, within=10).collect()} == {(1, 9)}


# -- chat


def test_conversations_round_trip(spark):
    import duckdb

    said = ["hola </s>[INST] ␛1 ␛", None, "", "<<s>s>[/ROLE][BODY]", "<|endoftext|> é\n\n x", "[AN[ANS]S]"]
    rows = [(c, t, role, said[(c + t) % len(said)], "k") for c in (1, 2) for t, role in enumerate(["system", "user", "assistant", "tool[BODY]", None, "assistant"])] + [(None, 0, "assistant", "solo", "k"), (3, None, "user", "dos", "k"), (3, None, "user", "dos", "k")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    c = duckdb.connect()
    c.register("conversations", turns.toArrow())
    for w in c.sql(chat.OP7_SQL).fetchall():
        if w[0] != -7:
            assert tuple(got[w[0]]) == w
    starts = chat.format_conversations(turns).where("conv_id = 1").orderBy("seq").collect()
    assert [s.start for s in starts] == list(itertools.accumulate([0] + [len(s.ids) // 4 for s in starts[:-1]]))
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_byte_table_is_the_tokenizers_decoding():
    import public_tokenizers

    coder = chat._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    table = chat.token_bytes(coder)
    for text in ("hola é ñ \u1234 \n\t x", "<|endoftext|> 日本語 🙂", "", "\x00\x7f\xad\xa0"):
        ids = coder.encode(text, add_special_tokens=False).ids
        assert b"".join(table[i] for i in ids).decode() == text == coder.decode(ids, skip_special_tokens=False)


def test_one_long_conversation(spark):
    rows = [(5, k, "user" if k % 2 else "assistant", f"turn {k} " * (20_000 if k == 7 else 3)) for k in range(400)]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, loss string")
    formatted = chat.format_conversations(turns)
    got = chat.read_back(formatted, in_order=True).collect()
    assert got == chat.read_back(formatted.repartition(3)).collect() and len(got) == 1 and got[0].n_turns == 400
    assert got[0].loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


# -- html


def test_cut_is_minimal():
    for k in range(200):
        r = random.Random(k)
        n = r.randint(1, 8)
        u = [round(r.uniform(-2, 2), 3) for _ in range(n)]
        e = [(i, j, round(r.uniform(0, 1.5), 3)) for i in range(n) for j in range(i) if r.random() < 0.4]

        def cost(labels, u=u, e=e):
            return sum(x if x > 0 and not y else -x if x < 0 and y else 0 for x, y in zip(u, labels, strict=True)) + sum(w for i, j, w in e if labels[i] != labels[j])

        best = min(cost(c) for c in itertools.product([False, True], repeat=n))
        assert cost(html_extraction.minimum_cut(u, e)) == pytest.approx(best, abs=1e-5)
        assert cost(html_extraction.max_flow_sides(u, e)) == pytest.approx(best, abs=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="home sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for all of you.</div>
<article><h1>Head &amp; tail</h1><p>First&nbsp;paragraph <b>bold<br>text</b>.<p>Second &lt;one&gt; &#233;
 ends</p><div class="ad">Buy this now, it is cheap and good for all.</div><p>Third.</p><form><p>Your mail please</p></form></article>
<section id="comments"><p>Great article, thanks for writing it. I liked all of it very much indeed.</p></section><aside>Other things</aside><footer>&copy; 2024 Site</footer>"""


def test_pages(spark):
    want = "Head & tail\n\nFirst paragraph bold text.\n\nSecond <one> é ends\n\nThird."
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "u", "<p>" * 3000), (4, "u", "<div>" * 5000 + "word " * 50 + "."), (5, "u", "plain words only, " * 20)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(pages).collect()]
    assert got[0] == got[3] == (1, want, len(want)) and got[1] == (2, "", 0) and got[2] == (None, "", 0) and got[4] == (3, "", 0)
    assert got[6][1] == ("plain words only, " * 20).strip()
    assert html_extraction.extract(pages.limit(0)).count() == 0


# -- models


def test_gradients_by_finite_differences():
    net = language_id.ByteGRU(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, mask, y = r.integers(0, 4, (2, 5)), np.ones((5, 2)), np.array([0, 2])
    mask[3:, 1] = 0
    _, g = net.gradients(x, mask, y)
    for k, at in (("fWz", (1, 0)), ("fUr", (0, 2)), ("bUc", (2, 1)), ("bWc", (2, 2)), ("V", (4, 1)), ("b", (2,))):
        old, losses = net.p[k][at], []
        for d in (1e-2, -1e-2):
            net.p[k][at] = old + d
            losses.append(net.gradients(x, mask, y)[0])
        net.p[k][at] = old
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[k][at], abs=2e-4)


def test_languages_held_out(spark):
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "der"]}
    rows = [(i, " ".join("".join(random.Random(i * 50 + k).choices(parts[lang], k=2)) for k in range(30)), lang, "s") for i, lang in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "xx", "s"), (901, "123 ...", "xx", "s"), (None, "kalo milo", None, "s"), (902, "", "yy", "s")], "doc_id long, text string, lang string, score string")
    net = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, net).collect()}
    held = [i for i, *_ in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].lang_pred == rows[i][2] and 0.5 < got[i].score <= 1 for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "und", "xx"]
    assert language_id.train(docs.limit(0)) is None and language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_isotonic_pools_violators():
    x, y = quality_model.pool_adjacent(np.arange(5.0), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert x.tolist() == [0, 1, 2, 3, 4] and y.tolist() == [0, 0.5, 0.5, 1, 1]


def test_quality_held_out(spark):
    import zlib

    rows = [(i, prose(60, i) if i % 2 else " ".join(["RUIDO!!"] * 60 + [prose(10, i)])) for i in range(240)]
    docs = spark.createDataFrame([*[(*r, 1) for r in rows], (900, None, 1), (None, "", 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(5, None), (7000, 1), (3, 1)], "doc_id long, quality int")
    measured = quality_model.features(docs)
    got = {r.doc_id: r.score for r in quality_model.score(measured, quality_model.fit(measured, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == i % 2 for i in held]) > 0.97
    assert {r.score for r in quality_model.score(measured, quality_model.fit(measured, labels.limit(0))).collect()} == {0.5}


def test_statistics_of_nothing_are_zero():
    assert not quality_model.statistics(pa.array([None, "", " "], pa.string())).any()
