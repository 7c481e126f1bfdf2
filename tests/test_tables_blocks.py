"""Changes of keyed tables and edits of blocks, worked by hand."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, tables

CHANGE = "seq long, op string, id long, name string"


def test_a_sequence_of_folder_changes(spark):
    folders = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (7, "C")], "id long, name string")
    members = spark.createDataFrame([(10, "A", "x"), (11, "B", "x"), (12, "C", "x"), (13, None, "x"), (14, "Free", "x"), (15, "A", "x")], "id long, folder string, name string")
    batches = [
        [(1, "create", None, " A "), (2, "create", None, "New"), (3, "create", None, " "), (4, "rename", 1, "A1"), (5, "rename", 1, " A2 "), (6, "rename", 2, ""), (7, "rename", 99, "Z")],
        [(8, "create", None, "New"), (9, "delete", 7, None), (10, "rename", 7, "D"), (11, "move", 14, " A2"), (12, "move", 15, "  ")],
        [(13, "rename", 1, "B"), (14, "rename", 2, "E"), (15, "delete", 99, None)],
    ]
    seen = []
    for batch in batches:
        folders, members = tables.folder_changes(folders, members, spark.createDataFrame(batch, CHANGE))
        seen.append(({r.id: r.name for r in folders.collect()}, {r.id: r.folder for r in members.collect()}))
    assert members.columns == ["id", "folder", "name"]
    # A is free again once folder 1 is called otherwise, so it is created
    assert seen[0] == ({1: "A2", 2: "B", 3: "B", 7: "C", 8: "A", 9: "New"}, {10: "A2", 11: "B", 12: "C", 13: None, 14: "Free", 15: "A2"})
    assert seen[1] == ({1: "A2", 2: "B", 3: "B", 8: "A", 9: "New"}, {10: "A2", 11: "B", 12: None, 13: None, 14: "A2", 15: None})
    assert seen[2] == ({1: "B", 2: "E", 3: "B", 8: "A", 9: "New"}, {10: "B", 11: "E", 12: None, 13: None, 14: "B", 15: None})


def test_merge_and_cascade(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    changes = spark.createDataFrame([(2, "x", False, 1), (2, "y", None, 2), (3, None, True, 1), (9, "n", False, 1), (8, "m", True, 5)], "id long, t string, deleted boolean, seq long")
    once = tables.merge(target, changes)
    want = {(1, "a"), (2, "y"), (9, "n")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in tables.merge(once, changes).collect()}
    clips = spark.createDataFrame([(5, 1), (6, 2), (7, None)], "id long, project_id long")
    left, children = tables.without(target, {"clips": (clips, "project_id")}, spark.createDataFrame([(1,), (1,), (44,)], "id long"))
    assert {r.id for r in left.collect()} == {2, 3} and {tuple(r) for r in children["clips"].collect()} == {(6, 2), (7, None)}


def test_reorder(spark):
    beats = spark.createDataFrame([(1, 10, 0), (2, 10, 1), (3, 10, 2), (4, 11, 0)], "id long, ticket_id long, order_index long")
    lists = spark.createDataFrame([(10, [3, 4, 1, 3, 77])], "ticket_id long, ids array<long>")
    assert {r.id: r.order_index for r in tables.reordered(beats, lists).collect()} == {1: 2, 2: 1, 3: 3, 4: 0}


def run(spark, made, given=((0, 1000), (2000, 5000))):
    """Blocks after an expression over the column `x`, in a window from 0 to 6000."""
    df = spark.createDataFrame([([tuple(g) for g in given],)], f"x {blocks.BLOCKS}")
    return [tuple(r) for r in df.select(made(F.col("x")).alias("y")).first().y]


L = F.lit
W = lambda: (L(0), L(6000))


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda x: blocks.trimmed(x, L(1), L(True), L(500), *W()), [(0, 1000), (1000, 5000)]),  # stops at its neighbour
        (lambda x: blocks.trimmed(x, L(1), L(True), L(4900), *W()), [(0, 1000), (4700, 5000)]),  # keeps the least length
        (lambda x: blocks.trimmed(x, L(0), L(False), L(9000), *W()), [(0, 2000), (2000, 5000)]),
        (lambda x: blocks.trimmed(x, L(1), L(False), L(9000), *W()), [(0, 1000), (2000, 6000)]),  # stops at the window
        (lambda x: blocks.trimmed(x, L(0), L(False), L(-5), *W()), [(0, 300), (2000, 5000)]),
        (lambda x: blocks.trimmed(x, L(7), L(False), L(1), *W()), [(0, 1000), (2000, 5000)]),
        (lambda x: blocks.removed(x, L(0)), [(2000, 5000)]),
        (lambda x: blocks.removed(blocks.removed(x, L(0)), L(0)), [(2000, 5000)]),
        (lambda x: blocks.split(x, L(1), L(2300)), [(0, 1000), (2000, 2300), (2300, 5000)]),
        (lambda x: blocks.split(x, L(1), L(2299)), [(0, 1000), (2000, 5000)]),
        (lambda x: blocks.added(x, L(500), L(1700), *W()), [(0, 1000), (1000, 1700), (2000, 5000)]),  # pushed past the block that it begins in
        (lambda x: blocks.added(x, L(5600), L(1200), *W()), [(0, 1000), (1200, 2000), (2000, 5000)]),  # ends told the wrong way round, stopped before the next block
        (lambda x: blocks.added(x, L(1800), L(2600), *W()), [(0, 1000), (2000, 5000)]),  # 200 ms are too short
        (lambda x: blocks.added(x, L(5100), L(9000), *W()), [(0, 1000), (2000, 5000), (5100, 6000)]),
        (lambda x: blocks.with_splits(x, F.array(L(4000), L(500), L(1500), L(4000), L(2000))), [(0, 500), (500, 1000), (2000, 4000), (4000, 5000)]),
    ],
)
def test_block_edits(spark, made, want):
    assert run(spark, made) == want


def test_edits_in_order_and_the_document(spark):
    edits = [("split", 1, 3000, None, None), ("delete", 1, None, None, None), ("trim_start", 1, 2500, None, None), ("add", None, None, 900, 2500), ("nonsense", 0, 0, 0, 0)]
    df = spark.createDataFrame([([(0, 1000), (2000, 5000)], edits), ([(0, 1000)], [])], f"x {blocks.BLOCKS}, e array<{blocks.EDIT}>")
    got = df.select(blocks.edited(F.col("x"), F.col("e"), *W()).alias("y")).select("y", blocks.document(F.col("y")).alias("d")).collect()
    assert [tuple(r) for r in got[0].y] == [(0, 1000), (1000, 2500), (2500, 5000)]
    assert (got[0].d.lo, got[0].d.hi, got[0].d.cuts) == (0, 5000, []) and tuple(got[1].d) == (0, 1000, [])
    gaps = spark.createDataFrame([([(2000, 5000), (0, 1000), (5000, 6000)],)], f"x {blocks.BLOCKS}").select(blocks.document(F.col("x")).alias("d")).first().d
    assert (gaps.lo, gaps.hi, [tuple(c) for c in gaps.cuts]) == (0, 6000, [(1000, 2000)])
