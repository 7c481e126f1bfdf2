"""Operator 4: SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the majority of the bits of its shingles' XXH64. Two fingerprints that differ in at most
k bits agree in at least m - k of m blocks, so each distinct fingerprint is sent to one bucket for each choice of
m - k blocks (m = 6, k = 4: 15 buckets keyed by two blocks, 20 to 22 bits). Inside a bucket Hamming distances are
verified, and only a forest that links the bucket is written, never all its pairs: a search from one
fingerprint takes its partners out of the rest, so a bucket of near copies costs about its own size.
A bucket of more than `bucket_rows` fingerprints is split into chunks, and each pair of chunks is a bucket.
Equal fingerprints are one node from the start.

Null text: empty, fingerprint zero, linked like any other. A null doc_id keeps its fingerprint and takes no
part in links; its component is null. Repeated rows are each returned. Other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.line_dedup import small
from cadenza.llm.shared import checkpointed, id_and_text, stored


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ones, total = np.zeros(64, np.int64), n
    for at in range(0, n, 65536):
        s, e = starts[at : min(at + 65536, n)].tolist(), ends[min(width, len(words)) - 1 :][at : at + 65536].tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[x:y], seed) for x, y in zip(s, e, strict=False)), np.uint64, len(s))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(fp: str, blocks: int, distance: int):
    """Keys of a fingerprint's buckets: the choice of blocks above, their bits below."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in itertools.pairwise(edges)]
    keys = []
    for choice in itertools.combinations(range(blocks), blocks - distance):
        bits = F.lit(0).cast("long")
        for k in choice:
            bits = F.shiftleft(bits, edges[k + 1] - edges[k]).bitwiseOR(cut[k])
        keys.append(F.struct(F.lit(len(keys)).cast("int").alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (root, member) that join exactly what chains of close fingerprints join."""
    rest, roots, members = np.arange(len(fps)), [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= distance
            if near.any():
                taken = rest[near]
                rest = rest[~near]
                front += taken.tolist()
                roots += [root] * len(taken)
                members += taken.tolist()
    return roots, members


def links(nodes: DataFrame, distance: int = 4, blocks: int = 6, bucket_rows: int = 20_000) -> DataFrame:
    """Forest edges (a, b) between the ids of distinct fingerprints; nodes has fp and node."""
    keyed = nodes.select("fp", "node", F.explode(bucket_keys("fp", blocks, distance)).alias("key")).select("fp", "node", "key.choice", "key.bits")
    sizes = keyed.groupBy("choice", "bits").count()
    wide = checkpointed(sizes.where(F.col("count") > bucket_rows))
    whole = F.lit(0).cast("int")
    if wide.isEmpty():
        dealt = keyed.withColumn("i", whole).withColumn("j", whole)
    else:
        n = F.ceil(F.col("count") / bucket_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
        split = keyed.join(wide, ["choice", "bits"]).withColumn("pair", F.explode(pairs)).select(*keyed.columns, "pair.i", "pair.j")
        dealt = keyed.join(wide, ["choice", "bits"], "left_anti").withColumn("i", whole).withColumn("j", whole).unionByName(split)
    names = ["choice", "bits", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the bucket that may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, upto = (np.concatenate(held, 1) if held else np.zeros((6, 0), np.int64)), None
            else:
                rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (*names, "fp", "node")])
                rows = np.concatenate([*held, rows], 1)
            if not rows.shape[1]:
                continue
            starts = np.concatenate(([0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1))
            ends = np.append(starts[1:], rows.shape[1])
            if batch is not None:
                upto = starts[-1]
                held = [rows[:, upto:]]
                starts, ends = starts[:-1], ends[:-1]
            fps, node = rows[4].view(np.uint64), rows[5]
            a: list = []
            b: list = []
            many = ends - starts > 1
            twos = many & (ends - starts == 2)
            at = starts[twos]
            at = at[np.bitwise_count(fps[at] ^ fps[at + 1]) <= distance]
            for s, e in zip(starts[many & ~twos].tolist(), ends[many & ~twos].tolist(), strict=True):
                roots, members = forest(fps[s:e], distance)
                a += node[s:e][roots].tolist() if roots else []
                b += node[s:e][members].tolist() if members else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[at], np.array(a, np.int64)))), pa.array(np.concatenate((node[at + 1], np.array(b, np.int64))))], ["a", "b"])

    return dealt.repartition(*names).sortWithinPartitions(*names, "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int = 6, bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = checkpointed(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, distance, blocks, bucket_rows))
    # a node's id may also be that of a row with another fingerprint (repeated ids), so labels go by fingerprint
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(labels, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4, blocks: int = 6, bucket_rows: int = 20_000, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near copies the row with the smallest id, and all rows without an id; columns as in docs.

    Rows are told by 96-bit hashes, fingerprints are the nodes: an id's rows with different texts are decided apart. Of
    rows equal in id the one with the smallest hash stays, of wholly equal rows one.
    """
    key = ["doc_id", "h1", "h2"]
    rows = docs.select(F.struct("*").alias("row")).withColumns({"h1": F.xxhash64("row"), "h2": F.hash("row")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], [*key, "fp"])

    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    given = rows.select(F.col("row")[id_col].cast("long").alias("doc_id"), "h1", "h2", text.alias("text")).where("doc_id is not null")
    prints = stored(given.mapInArrow(run, "doc_id long, h1 long, h2 int, fp long"), "prints")
    nodes = checkpointed(prints.select("fp").distinct().withColumn("node", F.col("fp")))
    found = components(links(nodes, distance, blocks, bucket_rows)).withColumnRenamed("node", "fp")
    mine = prints.join(found, "fp", "left").select(*key, F.coalesce("component", "fp").alias("component"))
    # stored apart from the join, so a hot component's rows can be split there
    best = stored(mine.groupBy("component").agg(F.min(F.struct(*key)).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best"), "best")
    told = mine.join(small(best, broadcast_rows), "component").groupBy(*key).agg(F.first(F.struct(*key) == F.col("best")).alias("first"), F.count("*").alias("n"))
    told = stored(told.where("not first or n > 1").select(F.struct(*key).alias("key"), "first"), "told")
    near = F.struct(F.col("row")[id_col].cast("long").alias("doc_id"), "h1", "h2") == F.col("key")
    out = rows.join(small(told, broadcast_rows), near, "left_anti").select("row")
    equal = told.where("first")
    if not equal.isEmpty():
        out = out.unionByName(rows.join(small(equal, broadcast_rows), near).groupBy("key").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
