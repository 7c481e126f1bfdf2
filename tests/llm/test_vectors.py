"""Operators 2 and 10 against brute force."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import neighbours, queries, vector_dedup
from cadenza.llm.neighbours import search
from cadenza.llm.vector_dedup import near_vectors

from . import cases

NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [1.0, 0.0, 0.0], 1),
    (1, [1.0, 0.0, 0.0], 1),
    (2, [1.0, 0.1, 0.0], 1),
    (3, [1.0, 0.0, 0.0], 2),
    (4, [1.0, 0.0, 0.0], None),
    (5, None, 1),
    (6, [0.0, 0.0, 0.0], 1),
    (7, [1.0, None, 0.0], 1),
    (8, [NAN, 1.0, 0.0], 1),
    (9, [INF, 1.0, 0.0], 1),
    (10, [0.0, 1.0, 0.0], 1),
    (11, [0.0, 2.0, 0.0], 1),
    (12, [0.0, 1.0], 1),
    (None, [1.0, 0.0, 0.0], 1),
    (10, [0.0, 1.0, 0.0], 1),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "id", "v", "part", "c") for r in rows], cases.VECTORS)


def given(sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet'").fetchall()
    return [r for r in rows if r[1] is not None and np.isfinite(np.array(r[1], float)).all() and np.any(r[1])]


def force(rows, queries_, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [int(j) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_search_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = given(sf)
    want = force(rows, [r[0] for r in rows if r[0] % 100 == 0])
    got = defaultdict(list)
    for r in queries.op2_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    assert all(len(v) == 10 and v == sorted(v, key=lambda t: (t[1], t[0])) for v in got.values())
    found = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("block_rows", [2000, 2])
def test_search_odd_rows(spark, block_rows):
    got = search(table(spark, ODD), F.col("vec_id") % 5 == 0, k=3, partitions=2, probes=2, block_rows=block_rows).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [
        (0, 1, 1), (0, 2, 3), (0, 3, 4),
        (10, 1, 11), (10, 2, 2), (10, 3, 0),
    ]


def links_by_force(rows, threshold=0.93):
    n, edges = defaultdict(int), []
    for label in {r[2] for r in rows if r[2] is not None}:
        part = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in part], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        for a, b in zip(i.tolist(), j.tolist()):
            n[part[a][0]] += 1
            n[part[b][0]] += 1
            edges.append((part[a][0], part[b][0]))
    return n, cases.components([r[0] for r in rows], edges)


def planted(sf):
    """The given vectors, with exact and near copies of some."""
    rows, rng = given(sf), np.random.default_rng(4)
    rows = [(i, v, label) for i, v, label in rows if label is not None]
    for k in range(300):
        i, v, label = rows[k % 7]
        v = np.array(v)
        rows.append((10_000 + k, (v if k % 2 else v + rng.normal(size=len(v)) * np.abs(v).mean() * 0.25).astype("float32").tolist(), label))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_by_force(spark, monkeypatch, block):
    rows = planted(cases.SF)
    n, group = links_by_force(rows)
    monkeypatch.setattr(vector_dedup.link_counts, "__defaults__", (block,))
    got = near_vectors(table(spark, rows)).collect()
    links = sum(n.values())
    assert links
    assert sum(r.n_links for r in got) >= 0.99 * links
    assert all(r.n_links <= n[r.vec_id] for r in got)
    same = sum(r.component_id == group.get(r.vec_id, r.vec_id) for r in got)
    assert same >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_odd_rows(spark):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, ODD)).collect()), key=str)
    want = [(None, 0, None, True), (0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (10, 1, 10, True), (10, 1, 10, True), (11, 1, 10, False)]
    want += [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 12)]
    assert got == sorted(want, key=str)


def results(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_an_id_of_two_labels_joins_nothing_across_them(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.01, 0.0], 0)]
    assert results(near_vectors(table(spark, rows))) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_an_id_of_two_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [1.0, 0.0, 0.0, 0.01], 0)]
    assert results(near_vectors(table(spark, rows))) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_labels_and_lengths_by_force(spark, seed):
    """Small labels, so each pair comes within a window and the result must be whole."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(150):
        dims = int(rng.integers(2, 4))
        v = rng.integers(-2, 3, dims) + (rng.normal(size=dims) * 0.1 if rng.random() < 0.5 else 0)
        rows.append((None if rng.random() < 0.03 else int(rng.integers(0, 60)), None if rng.random() < 0.03 else v.astype("float32").tolist(), None if rng.random() < 0.05 else int(rng.integers(0, 3))))
    rows += rows[:40]
    fine = lambda r: r[0] is not None and r[2] is not None and r[1] is not None and any(r[1])
    nodes = sorted({(i, g, tuple(v)) for i, v, g in filter(fine, rows)})
    unit = [np.array(v, float) / np.linalg.norm(v) for _, _, v in nodes]
    n, edges = defaultdict(int), []
    for a in range(len(nodes)):
        for b in range(a):
            if nodes[a][1] == nodes[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                # equal vectors of one node are told by id, other vectors of the same id are vectors of their own
                n[nodes[a]] += 1
                n[nodes[b]] += 1
                edges.append((a, b))
    group = cases.components(range(len(nodes)), edges)
    name = {}
    for k, node in enumerate(nodes):
        name[group[k]] = min(node[0], name.get(group[k], node[0]))
    at = {node: k for k, node in enumerate(nodes)}
    want = []
    for r in rows:
        if fine(r):
            node = (r[0], r[2], tuple(r[1]))
            component = name[group[at[node]]]
            want.append((r[0], n[node], component, r[0] == component))
        else:
            want.append((r[0], 0, r[0], True))
    assert edges and results(near_vectors(table(spark, rows))) == sorted(want, key=str)


def test_empty_tables(spark):
    none = table(spark, ODD).limit(0)
    assert search(none, F.lit(True)).count() == 0
    assert near_vectors(none).count() == 0
    unusable = table(spark, [r for r in ODD if r[0] in (5, 6, 8)])
    assert search(unusable, F.lit(True)).count() == 0
    assert near_vectors(unusable).count() == 3


def clustered(n, dims=16, centers=40, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dims)) * 4
    x = c[rng.integers(0, centers, n)] + rng.normal(size=(n, dims))
    return [(k, v, 1) for k, v in enumerate(x.astype("float32").tolist())]


@pytest.mark.parametrize("n", [3000, 12_000])
def test_recall_on_rows_outside_the_sample(spark, n):
    rows = clustered(n)
    got = defaultdict(set)
    for r in search(table(spark, rows), F.col("vec_id") % 100 == 0, sample=1024).collect():
        got[r.query_id].add(r.vec_id)
    want = force(rows, range(0, n, 100))
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_clusters_need_few_parts():
    x = np.array([r[1] for r in clustered(4000)], float)
    model = neighbours.fit(x, 16, 10, 0.93)
    assert model["probes"] <= 8


def test_distances_beyond_the_square_root_of_the_largest_double(spark):
    rows = spark.createDataFrame([(0, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [3e200, 0.0]), (3, [1.7e308, -1.7e308]), (4, [-1.7e308, 1.7e308])], "vec_id long, embedding array<double>")
    got = search(rows, F.col("vec_id").isin(0, 3), k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4), (3, 0), (3, 1), (3, 2), (3, 4)]
    assert got[0].score == pytest.approx(2**0.5 * 1e200) and got[-1].score == INF
