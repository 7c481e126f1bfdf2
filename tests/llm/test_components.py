"""Components of chains, stars and random graphs, and the number of rounds."""

import random

import pytest

from cadenza.llm import components as c

from . import cases


def found(spark, edges, monkeypatch):
    rounds = []
    once = c.contracted
    monkeypatch.setattr(c, "contracted", lambda e, seed: rounds.append(seed) or once(e, seed))
    got = {r[0]: r[1] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    return got, len(rounds)


@pytest.mark.parametrize("n", [20, 1000])
def test_chain_of_ascending_ids(spark, monkeypatch, n):
    got, rounds = found(spark, [(k, k + 1) for k in range(n)], monkeypatch)
    assert got == dict.fromkeys(range(n + 1), 0)
    assert rounds <= 4 * n.bit_length()


def test_long_chain(spark, monkeypatch):
    n = 100_000
    rounds = []
    once = c.contracted
    monkeypatch.setattr(c, "contracted", lambda e, seed: rounds.append(seed) or once(e, seed))
    chain = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    assert [tuple(r) for r in c.components(chain).groupBy("component").count().collect()] == [(0, n + 1)]
    assert len(rounds) <= 40


def test_random_graph_with_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(5, 5), (7, None), (None, 7), (900, 901), (901, 900)]
    edges += [(1000, k) for k in range(1001, 1200)]
    got, _ = found(spark, edges, monkeypatch)
    true = [e for e in edges if None not in e and e[0] != e[1]]
    nodes = {n for e in true for n in e}
    assert got == cases.components(nodes, true)


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []
