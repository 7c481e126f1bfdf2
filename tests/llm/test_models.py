"""Operators 6 and 9: held-out accuracy, and a field small enough to sum over all labellings."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest

from cadenza.llm import language, quality, queries

from . import cases

BIG = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in queries.op6_quality(spark, BIG).collect()}
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{BIG}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    held = [(rows[i], q) for i, q in truth if i in rows and rows[i].held_out]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i, r in rows.items() if r.held_out)
    assert len(held) > 100
    assert np.mean([r.predicted == q for r, q in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_marginals_by_all_labellings():
    rng = np.random.default_rng(1)
    good, moves, lines = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 1, 2])
    want, at = [], 0
    for n in lines:
        total, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(good[at : at + n] @ np.array(y) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += w
            mass += w * np.array(y)
        want += (mass / total).tolist()
        at += n
    assert quality.marginals(good, lines, moves)[0] == pytest.approx(want)


def test_quality_odd_rows(spark):
    docs = cases.odd(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 0, 0), (8, None, 0), (None, 1, 0), (12, 0, 0), *((k, 1, 0) for k in (7, 9, 10, 11, 13))], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(cases.TEXTS)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rows)


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in queries.op9_language(spark, BIG).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang, text FROM '{BIG}/documents.parquet'").fetchall()
    assert len(rows) == len(truth)
    held = [rows[i].lang_pred == lang for i, lang, text in truth if rows[i].held_out and lang and text]
    assert len(held) > 100
    assert np.mean(held) >= 0.95


def test_language_odd_rows(spark):
    docs = cases.odd(spark)
    rows = language.identify(docs, language.fit(docs)).collect()
    assert len(rows) == len(cases.TEXTS)
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert by[12].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    docs, none = cases.odd(spark), cases.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    assert language.fit(none) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert quality.scored(none, None).count() == 0
    assert language.identify(none, None).count() == 0


def quality_by_force(text, model):
    """The score of one text, its marginals summed over all labellings."""
    own, size, lines = quality.line_features([text])
    n, zero = len(own), np.zeros(own.shape[1])
    x = np.array([[*own[k], *(own[k - 1] if k else zero), *(own[k + 1] if k + 1 < n else zero), 1] for k in range(n)])
    odds, moves = x @ model["w"], model["moves"]
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(odds @ np.array(y) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
        total, mass = total + w, mass + w * np.array(y)
    p = float(np.average(mass / total, weights=[len(line) + 1 for line in text.split(b"\n")]))
    p = min(max(p, 1e-6), 1 - 1e-6)
    a, b = model["scale"]
    return 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b)))


def test_quality_by_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{cases.SF}/documents.parquet'").fetchall()
    table = cases.table(spark, docs + cases.TEXTS)
    model = quality.fit(table, queries.table(spark, cases.SF, "labels"))
    few = [(i, t or "") for i, t in docs + cases.TEXTS if i is not None and (t or "").count("\n") < 10]
    got = {}
    for r in quality.scored(table, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert len(few) > 50
    for i, t in few:
        assert min(abs(s - quality_by_force(t.encode(), model)) for s in got[i]) < 1e-6


def test_features_by_hand():
    own, size, lines = quality.line_features([b"Ab c.\n\nno no 12!", b""])
    assert size.tolist() == [5, 0, 9, 0] and lines.tolist() == [3, 1]
    first = [np.log1p(5) / 5, 1 / 4, 3 / 6, 0, 1 / 6, 0, 0, 0, 1 / 2, 0, 1, 0]
    third = [np.log1p(9) / 5, 0, 4 / 10, 2 / 10, 2 / 10, 1, 0, 0, 0, 2 / 3, 0, 0]
    assert own[0].tolist() == pytest.approx(first) and own[2].tolist() == pytest.approx(third)
    assert own[1].tolist() == own[3].tolist() == [0.0] * 11 + [1.0]


def test_a_text_of_very_many_lines():
    model = {"w": np.zeros(37), "moves": np.eye(2), "scale": (1.0, 0.0)}
    assert quality.score_texts([b"line\n" * 60_000, b"one"], model) == pytest.approx([0.5, 0.5])


def language_by_force(text, model):
    """The language and cosine of one text, from counts in a dictionary."""
    letters = "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower())
    raw, tf = b" " + b" ".join(letters.encode().split(None)) + b" ", {}
    for k in range(len(raw) - 2):
        g = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761) % 2**32 >> 19
        tf[g] = tf.get(g, 0) + 1
    v = {g: (1 + np.log(n)) * model["idf"][g] for g, n in tf.items()}
    norm = np.sqrt(sum(x * x for x in v.values()))
    cos = [sum(x * c[g] for g, x in v.items()) / norm for c in model["centroids"].astype(float)]
    return model["names"][int(np.argmax(cos))], max(cos), sorted(cos)[-2:]


def test_language_by_force(spark):
    docs = cases.documents()
    table = spark.createDataFrame([(i, t, "en de fr es".split()[i % 4]) for i, t in docs], "doc_id long, text string, lang string")
    model = language.fit(queries.table(spark, cases.SF, "documents"))
    texts = dict(docs)
    for r in language.identify(table, model).collect():
        name, cos, best = language_by_force(texts[r.doc_id], model)
        assert abs(r.score - cos) < 1e-4
        assert r.lang_pred == name or abs(best[1] - best[0]) < 1e-4


def test_signs_are_no_letters(spark):
    model = language.fit(queries.table(spark, cases.SF, "documents"))
    docs = cases.table(spark, [(1, "² ½ Ⅷ 12"), (2, "½ a")])
    assert [r.lang_pred == "und" for r in sorted(language.identify(docs, model).collect())] == [True, False]


def test_languages_are_bounded(spark):
    """Of many values of lang the commonest are learned, ties by name."""
    rows = [(k, f"text of kind {k % 40} and more", f"l{k % 40:02d}", "s", 1) for k in range(400)] + [(1000 + k, "plus de texte", "fr", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    few = language.fit(docs, languages=5)
    assert set(few["names"]) < {r[2] for r in rows} and "fr" in few["names"] and len(set(few["names"])) == 5
