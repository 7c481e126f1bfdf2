"""Edits of a timeline's blocks: arrays of struct(a, b) in milliseconds, in order and without overlap, as columns.

Every edit takes blocks to blocks; `edited` folds a list of edits over them. An edit that can't be made leaves the blocks as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shortest block.
LEAST = 300
BLOCKS = "array<struct<a:bigint,b:bigint>>"
EDIT = "struct<op:string,i:int,t:bigint,a:bigint,b:bigint>"


def block(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def put(blocks: Column, i: Column, new: Column) -> Column:
    """blocks with block i replaced by those of an array; i counts from 0."""
    after = F.greatest(F.size(blocks) - i - 1, F.lit(0))
    return F.concat(F.slice(blocks, F.lit(1), i), new, F.slice(blocks, i + 2, after))


def there(blocks: Column, i: Column) -> Column:
    return (i >= 0) & (i < F.size(blocks))


def trimmed(blocks: Column, i: Column, start: Column, t: Column, lo: Column, hi: Column) -> Column:
    """Block i with its start (where `start`) or its end moved to t, no shorter than the least, not across its neighbours or the window [lo, hi)."""
    own = F.get(blocks, i)
    before, after = F.coalesce(F.get(blocks, i - 1)["b"], lo), F.coalesce(F.get(blocks, i + 1)["a"], hi)
    a = F.greatest(before, F.least(t, own["b"] - LEAST))
    b = F.least(after, F.greatest(t, own["a"] + LEAST))
    new = F.when(start, block(a, own["b"])).otherwise(block(own["a"], b))
    return F.when(there(blocks, i), put(blocks, i, F.array(new))).otherwise(blocks)


def removed(blocks: Column, i: Column) -> Column:
    """blocks without block i; the only one stays."""
    return F.when(there(blocks, i) & (F.size(blocks) > 1), put(blocks, i, F.array().cast(BLOCKS))).otherwise(blocks)


def split(blocks: Column, i: Column, t: Column) -> Column:
    """Block i as two that meet at t, where both are long enough."""
    own = F.get(blocks, i)
    fits = there(blocks, i) & (t - own["a"] >= LEAST) & (own["b"] - t >= LEAST)
    return F.when(fits, put(blocks, i, F.array(block(own["a"], t), block(t, own["b"])))).otherwise(blocks)


def added(blocks: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """A new block between a and b in free space: pushed past the block that it begins in, stopped before the next."""
    first = F.aggregate(F.array_sort(blocks), F.greatest(lo, F.least(a, b)).cast("long"), lambda at, x: F.when((at >= x["a"]) & (at < x["b"]), x["b"]).otherwise(at))
    upto = F.least(hi, F.greatest(a, b)).cast("long")
    # the fold's result is needed several times: an array of one carries it
    placed = F.transform(F.array(first), lambda at: block(at, F.coalesce(F.array_min(F.transform(F.filter(blocks, lambda x: (x["a"] >= at) & (x["a"] < upto)), lambda x: x["a"])), upto)))
    return F.array_sort(F.concat(blocks, F.filter(placed, lambda x: x["b"] - x["a"] >= LEAST)))


def with_splits(blocks: Column, marks: Column) -> Column:
    """Blocks split again at marks that lie inside one, as blocks that meet can't be told from one by their gaps; halves may be short."""
    cut = lambda x: F.array_distinct(F.array_sort(F.concat(F.array(x["a"], x["b"]), F.filter(marks, lambda m: (m > x["a"]) & (m < x["b"])))))
    pieces = lambda edges: F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda a, k: block(a, F.get(edges, k + 1)))
    return F.array_sort(F.flatten(F.transform(blocks, lambda x: pieces(cut(x)))))


def document(blocks: Column) -> Column:
    """struct(lo, hi, cuts): the outer bounds and the gaps between blocks."""
    own = F.array_sort(blocks)
    gaps = F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), lambda x, k: block(x["b"], F.get(own, k + 1)["a"]))
    return F.struct(F.get(own, F.lit(0))["a"].alias("lo"), F.element_at(own, -1)["b"].alias("hi"), F.filter(gaps, lambda g: g["b"] > g["a"]).alias("cuts"))


def edited(blocks: Column, edits: Column, lo: Column, hi: Column) -> Column:
    """blocks after edits (an array of EDIT) in order: trim_start and trim_end (i, t), delete (i), split (i, t), add (a, b)."""
    step = lambda now, e: (
        F.when(e["op"].isin("trim_start", "trim_end"), trimmed(now, e["i"], e["op"] == "trim_start", e["t"], lo, hi))
        .when(e["op"] == "delete", removed(now, e["i"]))
        .when(e["op"] == "split", split(now, e["i"], e["t"]))
        .when(e["op"] == "add", added(now, e["a"], e["b"], lo, hi))
        .otherwise(now)
    )
    return F.aggregate(edits, blocks.cast(BLOCKS), step)
