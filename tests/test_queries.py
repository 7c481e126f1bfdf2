"""Every query with SQL gives the rows that DuckDB gives; the others keep their invariants."""

import duckdb
import pytest

from cadenza.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents events conversations benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(found, cols, names):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[k]) for k in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(registry.oracles()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert rows(df.collect(), cols, df.columns) == rows(r.fetchall(), cols, names)


def test_moments_do_not_overlap_much(spark):
    by = {}
    for r in registry.queries()["find_moments"](spark, SF).collect():
        by.setdefault(r.project_id, []).append((r.start_ms, r.end_ms))
    assert by
    for spans in by.values():
        assert len(spans) <= 6
        spans.sort()
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert max(0, b - c) * 2 <= min(b - a, d - c)


def test_takes_and_lines_are_assigned_once(spark):
    found = registry.queries()["assign_takes"](spark, SF).collect()
    assert len({(r.batch, r.take_id) for r in found}) == len(found) == len({(r.batch, r.line_id) for r in found})
    assert all(r.score >= 0.55 for r in found)


def test_alignment_is_monotone(spark):
    last = {}
    for r in sorted(registry.queries()["align_words"](spark, SF).collect(), key=lambda r: (r.id, r.k)):
        assert 10 >= r.end >= r.start >= last.get(r.id, 0)
        last[r.id] = r.start
