"""Operator 13 against counting every phrase."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from cadenza.llm import collocations, queries

from . import cases

SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in ["phrase", "words", "f", "n", "l", "r", "score", "part", *cases.CLASHING])


def by_force(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    scored, swallowed = [], defaultdict(int)
    for (lang, p), a in f.items():
        if a < least or len(p) == 1:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        scored.append((lang, p, a, f[lang, p[:k]], f[lang, p[k:]], score))
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                swallowed[lang, q] = max(swallowed[lang, q], a)
    out = Counter()
    by_lang = defaultdict(list)
    for lang, p, a, left, right, score in scored:
        if not (len(p) == 2 and 100 * swallowed[lang, p] >= 50 * a):
            by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank, phrase.decode(), -a, left, right, n[lang], -score] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, *r, *["x"] * 8, *cases.CLASHING) for k, r in enumerate(rows)], SCHEMA)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(map(tuple, df.collect()))


ODD = (
    [(t, g) for _, t in cases.TEXTS for g in ("en", None, "und")]
    + [("New York City, new york.\tNew\x0bYork city\x85here é É", "en")] * 12
    + [("a a a a a", "fr"), ("word " * 5_000 + "," + "b c d " * 3_000, "fr")]
    + [(None, None), ("", "xx"), ("...", "xx"), ("one two " * 9 + ". one", "xx")]
    + [(f"tie{k} pair{k} " * 10, "de") for k in range(30)]
)


@pytest.mark.parametrize(("sample_docs", "buffer_words"), [(20_000, 4_000_000), (10, 4_000_000), (0, 50)])
def test_odd_texts(spark, sample_docs, buffer_words):
    assert rows_of(collocations.best_phrases(table(spark, ODD), sample_docs=sample_docs, buffer_words=buffer_words)) == by_force(ODD)


def test_top_and_ties(spark):
    assert rows_of(collocations.best_phrases(table(spark, ODD), top=7)) == by_force(ODD, top=7)


def test_border_failures_need_more_passes(spark):
    """A sample of nothing proposes nothing: words fail first, then pairs; a sample of all closes at once."""
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    few, passes = collocations.frequent_phrases(docs, sample_docs=0)
    all_at_once, once = collocations.frequent_phrases(docs)
    assert (passes, once) == (3, 1)
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, all_at_once.collect()))


def test_full_bitmaps_only_count_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "bitmap", lambda phrases, words: __import__("numpy").full(1 << collocations.BITS - 3, 255, "uint8"))
    assert rows_of(collocations.best_phrases(table(spark, ODD))) == by_force(ODD)


def test_slices_keep_words_whole():
    text = ("Ab cd. ef\tgh " * 50 + "x" * 300 + " end").encode()
    want = [w for w in b" ".join(text.lower().replace(b".", b" \xff ").split()).split()]
    assert [w for part in collocations.slices(text, 7) for w in part] == want


def test_empty(spark):
    assert collocations.best_phrases(table(spark, [])).collect() == []


def test_query(spark):
    rows = duckdb.sql(f"SELECT text, lang FROM '{cases.SF}/documents.parquet'").fetchall()
    assert rows_of(queries.op13_collocations(spark, cases.SF)) == by_force(rows)
