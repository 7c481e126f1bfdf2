"""Rows that repeat a doc_id with other texts are decided by their own texts."""

from collections import Counter

import pytest

import corpus_pipeline

from cadenza.llm import line_dedup

from . import cases
from .test_copies import lines_by_force, print_of, sha

TEXTS = [(1, "a b c d e")]
for k in range(2, 22):  # one of the texts is similar to the first document's, the other to nothing
    pair = [(k, f"a b c d e x{k}"), (k, f"p{k} q{k} r{k} s{k} a")]
    TEXTS += pair if k % 2 else pair[::-1]
TEXTS += [(30, "one two three four five six\nlast line of it"), (30, "seven\none two three four five six"), (31, "last line of it"), (30, "one two three four five six")]


@pytest.mark.parametrize("rows", [500_000, 0])
def test_lines_of_namesakes(spark, rows):
    gone = lines_by_force(TEXTS)
    want = Counter()
    for i, t in TEXTS:
        lines, g = t.split("\n"), gone.get((i, t), set())
        want[i, len(lines), len(g), sha("\n".join(x for k, x in enumerate(lines) if k not in g).encode())] += 1
    assert sum(len(g) for g in gone.values()) == 22
    assert Counter(map(tuple, line_dedup.line_digests(cases.table(spark, TEXTS), broadcast_rows=rows).collect())) == want


def test_one_row_of_near_copies(spark):
    a, b, c = ("".join(f"{w}{k} " for k in range(60)) for w in ("red", "blue", "green"))
    texts = [(1, a), (2, a), (2, b), (3, b), (3, c), (4, "alone " + c), (4, c), (5, "quite another text"), (5, "quite another text"), (None, a), (None, a)]
    got = corpus_pipeline.one_of_near_copies(spark, cases.table(spark, texts), cases.SF)
    assert got.columns == cases.table(spark, texts).columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    apart = {print_of(t) for t in (a, b, c, "quite another text")}
    assert min((x ^ y).bit_count() for x in apart for y in apart if x != y) > 4
    want = Counter([(1, a), (2, b), (3, c), (5, "quite another text"), (None, a), (None, a)])
    if (print_of("alone " + c) ^ print_of(c)).bit_count() > 4:
        want[4, "alone " + c] += 1
    assert kept == want
