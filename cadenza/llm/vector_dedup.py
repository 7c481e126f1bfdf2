"""Operator 10: embedding near-duplicates by sorted projection passes.

In each of `passes` passes every vector gets a string of random-hyperplane bits, and the vectors of a label are
ordered lexicographically by it. Each vector is compared with the `window` vectors after it; pairs whose cosine
reaches the threshold are verified in double precision, and of each block of neighbours only a forest of them is written.
The union over all passes gives the components.

The number of passes grows with the vectors of the largest label, as the leading bits that a pair must share to come
within a window do. It is set so that an isolated pair at the threshold itself is expected to be found with
probability `recall` at any size, where the label's vectors are spread evenly over directions; `passes` is the least.

The window bounds candidates, so a vector with more near copies than that would miss links in its count. Therefore
a second step counts links exactly inside each component: its members are dealt into blocks, and each pair of
blocks is compared in one task, with counts written, not pairs. Every pair found in a pass is inside a component.

Ranks in the order come from range partitions and their sizes (a row each at the driver). Passes are parts of
one sort, and a label that a third of the rows have is ranges of that sort like any other.

Equal vectors of a label are one node from the start, with the number of their ids, so copies aren't compared with each
other; each row gets what its node gets. Nodes have numbers of their own, as an id may name several vectors.

Vectors that are null, zero, hold null or non-finite components, or have a null label link with nothing, and so do vectors of
different lengths. Null ids are returned with no links and a null component. Rows that repeat id, label and vector
count once and get the same result. Rows that repeat an id with another label or vector are vectors of their own, each with
its own links and component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.ordering import running
from cadenza.llm.shared import checkpointed, stored
from cadenza.llm.vectors import unpacked, usable


def unit_rows(vectors, dtype: str) -> np.ndarray:
    x = unpacked(vectors, dtype)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def needed_passes(size: int, threshold: float, window: int, recall: float) -> int:
    """Passes in which a pair at the threshold, alone among `size` spread vectors, comes within a window with probability `recall`.

    The two agree in a bit with 1 - angle / pi, and share a window once they agree in the leading bits that leave `window` vectors.
    """
    leading = math.log2(max(size / window, 1.0))
    once = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** leading
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log(1 - once))


def projected(rows: DataFrame, dtype: str, passes: int, bits: int, seed: int) -> DataFrame:
    """(pass, label, dims, code, node): a row for each vector and pass, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dims in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(pick))
                if dims not in planes:
                    planes[dims] = np.random.default_rng(seed).standard_normal((dims, passes * bits))
                codes = ((unpacked(part.column(1).to_pylist(), dtype) @ planes[dims]) > 0).reshape(-1, bits) @ place
                again = pa.array(np.repeat(np.arange(len(pick)), passes))
                columns = [pa.array(np.tile(np.arange(passes, dtype=np.int32), len(pick))), *(part.column(k).take(again) for k in (3, 2)), pa.array(codes), part.column(0).take(again)]
                yield pa.RecordBatch.from_arrays(columns, ["pass", "label", "dims", "code", "node"])

    return rows.select("node", "v", "dims", "label").mapInArrow(run, f"pass int, label {rows.schema['label'].dataType.simpleString()}, dims int, code long, node long")


def close_forest(x: np.ndarray, group: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a forest of close pairs at most `window` apart in the order and of one group."""
    root = np.arange(len(x))
    a: list[int] = []
    b: list[int] = []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(x), 256):
        upto = min(len(x), at + 256 + window)
        near = x[at : at + 256] @ x[at:upto].T >= threshold
        i, j = np.nonzero(near)
        fine = (j > i) & (j - i <= window)
        i, j = i[fine] + at, j[fine] + at
        same = group[i] == group[j]
        for p, q in zip(i[same].tolist(), j[same].tolist(), strict=True):
            s, t = top(p), top(q)
            if s != t:
                root[max(s, t)] = min(s, t)
                a.append(p)
                b.append(q)
    return np.array(a, int), np.array(b, int)


def links(rows: DataFrame, dtype: str, threshold: float, passes: int, window: int, bits: int, seed: int, block: int = 2048) -> DataFrame:
    """Edges (a, b) of nodes that join what the passes find close. The order is made of codes and nodes; vectors are fetched by the blocks."""
    order = ["pass", "label", "dims", "code", "node"]

    codes = stored(projected(rows, dtype, passes, bits, seed), "codes")
    ranked = running(codes, order)
    rank = F.col("before")
    home = F.floor(rank / block).cast("long")
    # a block also gets the `window` rows after its last one
    to = F.when((rank % block < window) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))
    dealt = ranked.select("pass", "label", "dims", "node", rank.alias("rank"), F.explode(to).alias("block")).join(rows.select("node", "v"), "node")

    def compare(key, frame):
        import pandas as pd

        frame = frame.sort_values("rank")
        group = frame["run"].to_numpy()
        nodes = frame["node"].to_numpy()
        a, b = [], []
        for g in np.unique(group):
            k = np.flatnonzero(group == g)
            i, j = close_forest(unit_rows(frame["v"].iloc[k], dtype), np.zeros(len(k)), window, threshold)
            a.append(nodes[k[i]])
            b.append(nodes[k[j]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    run = F.xxhash64("pass", "label", "dims").alias("run")
    return dealt.select("node", "v", "rank", "block", run).groupBy("block").applyInPandas(compare, "a long, b long")


def link_counts(members: DataFrame, dtype: str, threshold: float, block: int = 1024) -> DataFrame:
    """(node, n_links): exact numbers of ids with close vectors inside each component; members has component, label, node, v and n, the ids it stands for."""
    # stored apart from the join, so a hot component's rows can be split there
    sizes = checkpointed(members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    dealt = members.join(sizes, "component").withColumn("own", own).withColumn("pair", F.explode(pairs)).select("component", "node", "v", "n", "own", "pair.i", "pair.j")

    def compare(key, frame):
        import pandas as pd

        x, own_block, nodes = unit_rows(frame["v"], dtype), frame["own"].to_numpy(), frame["node"].to_numpy()
        near = (x @ x.T >= threshold) & (nodes[:, None] != nodes[None, :])
        if key[1] != key[2]:  # pairs within a block are counted where i = j
            near &= own_block[:, None] != own_block[None, :]
        return pd.DataFrame({"node": nodes, "links": near @ frame["n"].to_numpy()}).astype({"node": "int64", "links": "int64"})

    found = dealt.groupBy("component", "i", "j").applyInPandas(compare, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("n_links"))


def near_vectors(rows: DataFrame, threshold: float = 0.93, passes: int = 12, window: int = 64, bits: int = 24, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = 0.99) -> DataFrame:
    """Per row vec_id, n_links, component_id and kept; `recall` below 1 is that of isolated pairs at the threshold."""
    key = ["label", "dims", "h1", "h2"]  # equal for equal vectors of a label only, but for a chance below 2 to the -96 for any two

    plain, dtype = usable(rows, id_col, vec_col, label_col, all_rows=True)
    each = stored(plain.select(F.col("vec_id").alias("id"), "label", "dims", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")), "fine")
    fine = each.where("v is not null")
    grouped = fine.groupBy(key).agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count_distinct("id").alias("n"))
    distinct = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = distinct.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    passes = max(passes, needed_passes(largest, threshold, window, recall))
    bits = min(max(bits, math.ceil(math.log2(max(largest / window, 1.0))) + 8), 62)  # enough to tell windows apart
    found = components(checkpointed(links(distinct.select("node", "v", "dims", "label"), dtype, threshold, passes, window, bits, seed)))
    members = distinct.join(found, "node")
    # stored apart from the joins, so that the rows of a large component or of a common vector can be split there
    names = checkpointed(members.groupBy("component").agg(F.min("id").alias("name")))
    others = link_counts(members.select("component", "node", "v", "n"), dtype, threshold)
    told = distinct.select(*key, "node", "id", "n").join(found, "node", "left").join(names, "component", "left").join(others, "node", "left")
    told = checkpointed(told.select(*key, (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("name", "id").alias("component")))
    out = fine.select("id", *key).join(told, key).select("id", "n_links", "component")
    out = out.unionByName(each.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
