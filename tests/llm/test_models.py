"""Models and packing against step-by-step versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from kilowave.llm import language_id, packing, quality_model

from .messy import prose


def by_steps(net, text):
    """Mean log-probabilities of a text's bytes, window by window, a byte at a time."""
    total = np.zeros(len(net.languages))
    for lo in range(0, len(text), language_id.WINDOW):
        part = text[lo : lo + language_id.WINDOW]
        states = {}
        for way in "fb":
            p = {k: net.p[way + k].astype(float) for k in language_id.NAMES}
            h, out = np.zeros(net.hidden), {}
            for t in range(len(part)) if way == "f" else reversed(range(len(part))):
                z = 1 / (1 + np.exp(-(p["Wz"][part[t]] + h @ p["Uz"])))
                r = 1 / (1 + np.exp(-(p["Wr"][part[t]] + h @ p["Ur"])))
                c = np.tanh(p["Wc"][part[t]] + r * (h @ p["Uc"]))
                h = (1 - z) * h + z * c
                out[t] = h
            states[way] = out
        for t in range(len(part)):
            y = np.concatenate([states["f"][t], states["b"][t]]) @ net.p["V"].astype(float) + net.p["b"]
            total += y - y.max() - math.log(np.exp(y - y.max()).sum())
    return total / max(len(text), 1)


def test_pooled_probabilities_match_steps():
    net = language_id.ByteGRU(["a", "b", "c"], hidden=4)
    texts = [b"hola", "año nuevo, vida nueva ".encode() * 30, b"x" * 128, b"y" * 129, b"z"]
    column = pa.array([t.decode() for t in texts])
    got = net.pooled(*language_id.column_bytes(column))
    for row, text in zip(got, texts, strict=True):
        mean = by_steps(net, text)
        want = np.exp(mean - mean.max())
        assert row == pytest.approx(want / want.sum(), abs=1e-4)


def test_languages_of_ties_long_texts_and_repeated_rows(spark):
    net = language_id.ByteGRU(["aa", "bb"], hidden=3)
    net.p["V"][:] = 0  # every language is as likely: the first is taken
    docs = spark.createDataFrame([(1, "hola"), (1, "hola"), (2, "hola que tal " * 50_000), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify(docs, net).collect())
    assert got == [(1, "aa", 0.5), (1, "aa", 0.5), (2, "aa", 0.5), (3, "und", 0.0)]


def test_statistics_by_hand():
    text = "Uno dos! dos, 3|4 ñu\nUno dos! dos, 3|4 ñu"
    x = dict(zip(quality_model.FEATURES, quality_model.statistics(pa.array([text]))[0], strict=True))
    size = len(text.encode())
    assert x["log_words"] == pytest.approx(math.log1p(10)) and x["word_length"] == pytest.approx(sum(map(len, text.split())) / 10)
    assert x["bang"] == pytest.approx(2 / size) and x["pipes"] == pytest.approx(2 / size) and x["digits"] == pytest.approx(4 / size) and x["commas"] == pytest.approx(2 / size)
    assert x["not_ascii"] == pytest.approx(4 / size) and x["distinct"] == pytest.approx(5 / 10) and x["dup_lines"] == pytest.approx(1 / 2)
    assert x["upper"] == pytest.approx(2 / 20) and x["repeated"] == 1 and x["longest_word"] == pytest.approx(math.log1p(4))


def test_fit_solves_the_normal_equations(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, prose(r.randint(5, 60), i) + ("!" * r.randint(0, 30))) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(r.random() < 0.5)) for i in range(120)], "doc_id long, quality int")
    measured = quality_model.features(docs).cache()
    model = quality_model.fit(measured, labels, width=16)
    from pyspark.sql import functions as F

    rows = measured.join(labels.where(~quality_model.held_out()), "doc_id").withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()
    x, y = np.array([q.x for q in rows], float), np.array([q.quality for q in rows], float)
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-6) and model.scale[0] == pytest.approx(x[:, 0].std(), abs=1e-6)
    own = np.array([not q.aside for q in rows])
    z = model.lift(x[own])
    want = np.linalg.solve(z.T @ z + quality_model.RIDGE * np.diag([1.0] * 16 + [1e-6]), z.T @ y[own])
    assert model.weights == pytest.approx(want, abs=1e-6)
    assert (np.diff(model.knots[1]) >= 0).all()
    scores = model.score(x)
    assert ((scores >= 0) & (scores <= 1)).all() and np.corrcoef(np.argsort(np.argsort(model.raw(x))), np.argsort(np.argsort(scores)))[0, 1] > 0.99


def test_cosines_approximate_the_gaussian_kernel():
    model = quality_model.QualityModel(np.zeros(18), np.ones(18), width=20_000)
    x = np.random.default_rng(1).standard_normal((6, 18))
    got = model.lift(x)[:, :-1] @ model.lift(x)[:, :-1].T
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 18 / 2)
    assert got == pytest.approx(want, abs=0.03)


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    for seed in range(20):
        r = random.Random(seed)
        room = 24
        lengths = np.array([r.randint(1, room) for _ in range(80)])
        bins, offsets = packing.sum_of_squares(lengths, room)
        gaps, made = {}, 0
        for i in np.argsort(-lengths, kind="stable").tolist():
            s = int(lengths[i])

            def total(changed, gaps=gaps):
                held = list({**gaps, **changed}.values())
                return sum(held.count(g) ** 2 for g in range(1, room))

            choices = {g: total({b: g - s}) for b, g in gaps.items() if g >= s} | {room: total({made: room - s})}
            b = int(bins[i])
            before = gaps.get(b, room)
            assert offsets[i] == room - before and (b in gaps or b == made)
            assert choices[before] == min(choices.values())
            made += b == made
            gaps[b] = before - s
