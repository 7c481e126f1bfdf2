"""Operator 2: approximate nearest neighbours by learned partitions.

On a bounded, hash-chosen sample of at most `sample` vectors the driver builds a neighbour graph, divides it into
balanced parts (recursive bisection along the graph's second eigenvector, cut at the median, then swaps that lower
the cut), and fits a small classifier (one hidden layer) that predicts which parts hold a vector's neighbours.
Every row is indexed under its most probable part; a query goes to its most probable parts and is ranked there by
exact distance in double precision.

The number of parts grows with the square root of the rows, between 16 and one for 64 rows of the sample. How many parts a query probes is
set on an eighth of the sample that the model doesn't learn from: the fewest that hold `recall` of those vectors' neighbours
in the rest. Vectors in clusters need few parts; vectors spread evenly over many dimensions need most of them, as
any index of parts does. A query whose parts hold no more than k rows probes on until they do.

A part's rows are dealt into blocks of about `block_rows`, and queries into blocks of as many, so no task gets a whole part; each
pair of blocks gives its best k, and the bests are merged by query. Queries are a stated set of rows.

Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part; neither do null ids. Fewer
candidates than k: all of them. A distance beyond the largest double is infinite and still ranked. Ties go to the smaller id. Repeated ids: a query's own id is never its neighbour, and
each (query, neighbour) is returned once. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import stored
from cadenza.llm.vectors import unpacked, usable

OUT = "query_id long, vec_id long, distance double"


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    out = np.empty((len(x), k), np.int64)
    squares = (x**2).sum(1)
    for at in range(0, len(x), 512):
        d = squares[None] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(members: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, first: int, out: np.ndarray, rng: np.random.Generator) -> None:
    """Divide members into `parts` parts of equal size along the graph's slowest vectors; a, b are its edges."""
    if parts == 1 or len(members) < 2:
        out[members] = first
        return
    place = np.full(len(out), -1)
    place[members] = np.arange(len(members))
    pa_, pb = place[a], place[b]
    inside = (pa_ >= 0) & (pb >= 0)
    i, j = np.concatenate((pa_[inside], pb[inside])), np.concatenate((pb[inside], pa_[inside]))
    n = len(members)
    degree = np.sqrt(np.bincount(i, minlength=n) + 1.0)
    top = degree / np.linalg.norm(degree)
    y = rng.standard_normal(n)
    for _ in range(60):  # power steps on the normalised adjacency plus one, away from its first vector
        y -= top * (top @ y)
        y = y + np.bincount(i, y[j] / degree[j], n) / degree
        y /= np.linalg.norm(y) + 1e-12
    y = y / degree
    left = parts // 2
    cut = n * left // parts
    side = np.zeros(n, bool)
    side[np.argsort(y, kind="stable")[cut:]] = True
    for _ in range(12):  # swap equally many that have more neighbours on the other side
        other = np.bincount(i, (side[i] != side[j]).astype(float), n) * 2 - np.bincount(i, minlength=n)
        go, come = (np.flatnonzero((side == s) & (other > 0)) for s in (False, True))
        m = min(len(go), len(come)) // 2
        if not m:
            break
        go, come = (z[np.argsort(-other[z], kind="stable")[:m]] for z in (go, come))
        side[go], side[come] = True, False
    bisect(members[~side], a, b, left, first, out, rng)
    bisect(members[side], a, b, parts - left, first + left, out, rng)


def classifier(x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 300, seed: int = 3) -> list[np.ndarray]:
    """Weights of a network with one hidden layer, fitted to the target shares by Adam on batches."""
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) / np.sqrt(hidden), np.zeros(target.shape[1])]
    m1, m2 = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(x), min(512, len(x)))
        h = np.maximum(0, x[pick] @ w[0] + w[1])
        p = softmax(h @ w[2] + w[3])
        e = (p - target[pick]) / len(pick)
        back = (e @ w[2].T) * (h > 0)
        for k, g in enumerate((x[pick].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum(0))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g**2
            w[k] = w[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, partitions: int, k: int, recall: float) -> dict | None:
    """The model from the sample's vectors, with the number of parts to probe."""
    if len(x) < 2:
        return None
    rng = np.random.default_rng(11)
    held = np.arange(len(x)) % 8 == 7 if len(x) >= 64 else np.zeros(len(x), bool)
    unit = np.abs(x).max()  # squares of what is fitted can't overflow
    x, asked = x[~held] / unit, x[held] / unit
    mean, scale = x.mean(0), x.std() + 1e-12
    near = graph(x, min(k, len(x) - 1))
    part = np.zeros(len(x), np.int64)
    bisect(np.arange(len(x)), np.repeat(np.arange(len(x)), near.shape[1]), near.ravel(), partitions, 0, part, rng)
    target = np.eye(partitions)[part[near]].sum(1) + np.eye(partitions)[part]
    model = {"unit": 1.0, "mean": mean, "scale": scale, "w": classifier((x - mean) / scale, target / target.sum(1, keepdims=True)), "partitions": partitions}
    model["probes"] = partitions
    if len(asked):
        home = parts_of(model, x, 1)[:, 0]
        ranks = np.argsort(parts_of(model, asked, partitions), axis=1)  # of each part for each vector
        d = (asked**2).sum(1)[:, None] - 2 * asked @ x.T + (x**2).sum(1)[None]
        true = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
        found = np.bincount(np.take_along_axis(ranks, home[true], 1).ravel(), minlength=partitions).cumsum() / true.size
        model["probes"] = int(np.searchsorted(found, recall) + 1)
    return model | {"unit": unit}


def parts_of(model: dict | None, x: np.ndarray, many: int) -> np.ndarray:
    """The most probable parts of each vector, best first."""
    if model is None:
        return np.zeros((len(x), 1), np.int32)
    w = model["w"]
    z = np.maximum(0, (x / model["unit"] - model["mean"]) / model["scale"] @ w[0] + w[1]) @ w[2] + w[3]
    return np.argsort(-z, axis=1, kind="stable")[:, :many].astype(np.int32)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - v) ** 2).sum(1))
        for j in np.flatnonzero(np.isinf(d)):  # the squares overflow; the distance need not
            most = np.abs(x[j] - v).max()
            d[j] = most * np.sqrt((((x[j] - v) / most) ** 2).sum()) if np.isfinite(most) else np.inf
    return d


def nearest_in(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, neighbour ids, distances) of each query's k nearest among x, ties to the smaller id; an id counts once."""
    a, b, c = [], [], []
    repeated = len(np.unique(x_ids)) < len(x_ids)
    for v, own in zip(q, q_ids, strict=True):
        d = distances(x, v)
        open_ = x_ids != own
        if repeated:
            first = np.lexsort((d, x_ids))
            open_[first[1:][x_ids[first[1:]] == x_ids[first[:-1]]]] = False
        at = np.flatnonzero(open_)
        m = min(k, len(at))
        if m < len(at):
            at = at[d[at] <= np.partition(d[at], m - 1)[m - 1]]
        best = at[np.lexsort((x_ids[at], d[at]))][:m]
        a.append(np.full(len(best), own))
        b.append(x_ids[best])
        c.append(d[best])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def parts_for(total: int, sample: int) -> int:
    return max(2, min(max(16, math.isqrt(total) // 8), min(total, sample) // 64))


def search(rows: DataFrame, is_query: Column, k: int = 10, partitions: int | None = None, probes: int | None = None, sample: int = 8192, recall: float = 0.93, block_rows: int = 2000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows found; score is the Euclidean distance."""
    spark = rows.sparkSession
    fine, dtype = usable(rows, id_col, vec_col)
    sizes = fine.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, total = (sizes[0][0], sizes[0][1]) if sizes else (0, 0)
    fine = fine.where(F.col("dims") == dims).select("vec_id", "v")
    order = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    picked = fine.where(order < int((1 << 30) * min(1.0, 1.1 * sample / max(1, total)))).limit(2 * sample).collect() if total else []
    picked.sort(key=lambda r: (r[0], bytes(r[1])))
    fitted = fit(unpacked([bytes(r[1]) for r in picked][:sample], dtype), partitions or parts_for(total, sample), k, recall) if picked else None
    model = spark.sparkContext.broadcast(fitted)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = parts_of(model.value, unpacked(batch.column(1).to_pylist(), dtype), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[:, 0])], ["vec_id", "v", "part"])

    shape = "vec_id long, v binary, part int"
    indexed = stored(fine.mapInArrow(at_home, shape), "index")
    held = {r[0]: r[1] for r in indexed.groupBy("part").count().collect()}  # a row a part
    count = np.array([held.get(p, 0) for p in range(fitted["partitions"] if fitted else 1)])
    least = probes or (fitted["probes"] if fitted else 1)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = parts_of(model.value, unpacked(batch.column(1).to_pylist(), dtype), len(count))
            before = np.cumsum(count[ranked], axis=1) - count[ranked]
            i, j = np.nonzero((np.arange(ranked.shape[1]) < least) | (before <= k))
            pick = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(ranked[i, j])], ["vec_id", "v", "part"])

    chosen = usable(rows.where(is_query), id_col, vec_col)[0].where(F.col("dims") == dims).select("vec_id", "v")
    asked = stored(chosen.mapInArrow(probing, shape), "asked")

    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))  # a row a part

    row_n, ask_n = F.broadcast(blocks(indexed).withColumnRenamed("n", "rn")), F.broadcast(blocks(asked).withColumnRenamed("n", "qn"))
    rows_dealt = indexed.join(row_n, "part").join(ask_n, "part").withColumn("rb", F.pmod(F.hash("vec_id"), "rn")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
    asks_dealt = asked.join(row_n, "part").join(ask_n, "part").withColumn("qb", F.pmod(F.hash("vec_id"), "qn")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)))
    keys = ["part", "rb", "qb"]

    def ranked(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})
        q, v, d = nearest_in(unpacked(left["v"], dtype), left["vec_id"].to_numpy(), unpacked(right["v"], dtype), right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "distance": d})

    cols = [*keys, "vec_id", "v"]
    found = asks_dealt.select(cols).groupBy(keys).cogroup(rows_dealt.select(cols).groupBy(keys)).applyInPandas(ranked, OUT)
    # of each query: parts x blocks x k rows at most, reduced before the shuffle by the sort-free aggregate below
    once = found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    best = once.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))), 1, k).alias("best"))
    flat = best.select("query_id", F.posexplode("best").alias("pos", "x"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.distance").alias("score"))
