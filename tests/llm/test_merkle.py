"""Operator 12 against a tree built by hand."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cadenza.llm import merkle, queries

from . import cases


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return h(*(field(v) for v in row))


def rise(nodes, fanout=8):
    """The root, and for each node its siblings (left, right) from below."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p // fanout * fanout
            paths[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        at = [p // fanout for p in at]
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_force(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = rise([leaf_of(r) for r in groups[g]])
    root, tops = rise([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            claimed = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claimed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf_of(claimed)
            for left, right in path + top:
                node = h(left, node, right)
            out.append((r[0], leaf_of(r), trees[g][0], root, h(*(a + b for a, b in path + top)), node, node == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"`{c}` string" for c in ["grp", "rank", "n", "digest", "path", "id", "row", *cases.CLASHING])


def check(spark, rows):
    docs = spark.createDataFrame([(*r, *["x"] * 7, *cases.CLASHING) for r in rows], SCHEMA)
    got = Counter(map(tuple, merkle.proofs(docs, merkle.lowered_third()).select(*COLUMNS).collect()))
    assert got == by_force(rows)
    return got


def test_odd_rows(spark):
    rows = [(i, s, g, None if i == 5 else len(t or ""), t) for i, t in cases.TEXTS for s, g in (("s", "en"), (None, None), ("S", "é"))]
    rows += [(i, "Src", "en", 3, f"Text {i % 7}") for i in range(-40, 90)]
    rows += [(7, "Src", "en", 3, "Text")] * 130 + [(None, "a", "de", 1, "B")] * 3 + [(1 << 62, "a", "zz", 1, "B"), (-(1 << 63), "a", "zz", 1, "B"), (63, "a", "zz", 1, "A"), (127, "a", "zz", 1, "A")]
    got = check(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_of_a_group(spark, n):
    check(spark, [(i * 3, "s", "en", 1, f"T{i}") for i in range(n)] + [(5, "s", None, 1, "Lone")])


def test_many_groups(spark):
    check(spark, [(i, "s", f"g{i % 70}", 1, f"T{i}") for i in range(200)])


def test_empty(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_untouched_texts_verify(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    assert merkle.proofs(docs).where("not verified").isEmpty()


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{cases.SF}/documents.parquet'").fetchall()
    assert Counter(map(tuple, queries.op12_merkle(spark, cases.SF).select(*COLUMNS).collect())) == by_force(rows)
