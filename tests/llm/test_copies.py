"""Operators 4, 7 and 8 against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from cadenza.llm import line_dedup, queries, simhash, substrings
from cadenza.llm.shared import id_and_text

from . import cases

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def print_of(text, width=4):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [words] if len(words) < width else [words[k : k + width] for k in range(len(words) - width + 1)]
    ones = [0] * 64
    for h, n in Counter(xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts).items():
        for bit in range(64):
            ones[bit] += n * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if ones[bit] * 2 > len(parts))


def simhash_by_force(texts, distance=4):
    prints = [(i, print_of(t)) for i, t in texts]
    distinct = sorted({f for i, f in prints if i is not None})
    fps = np.array(distinct, np.uint64)
    edges = []
    for k, f in enumerate(fps):
        edges += [(k, int(j)) for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= distance) if j > k]
    group = cases.components(range(len(distinct)), edges)
    least = {}
    for i, f in prints:
        if i is not None:
            g = group[distinct.index(f)]
            least[g] = min(i, least.get(g, i))
    return Counter((i, f"{f:016x}", None if i is None else least[group[distinct.index(f)]]) for i, f in prints)


@pytest.mark.parametrize("kind", ["odd", "given"])
@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_simhash_components(spark, kind, bucket_rows):
    texts = cases.TEXTS if kind == "odd" else cases.documents()
    got = simhash.near_duplicates(cases.table(spark, texts), bucket_rows=bucket_rows)
    assert Counter(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == simhash_by_force(texts)


def test_simhash_links_at_most_four_bits(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40).tolist()
    fps = list(dict.fromkeys(b ^ sum(1 << int(x) for x in rng.choice(63, n, replace=False)) for b in base for n in (0, 3, 4, 5, 8)))
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    from cadenza.llm.components import components

    edges = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if (a ^ b).bit_count() <= 4]
    want = cases.components(range(len(fps)), edges)
    linked = {n for e in edges for n in e}
    got = {r[0]: r[1] for r in components(simhash.links(nodes)).collect()}
    assert got == {n: want[n] for n in linked}


def lines_by_force(texts, threshold=0.8):
    """{(doc_id, text): line numbers that go}."""
    rows = sorted({(i, t or "") for i, t in texts if i is not None})
    lines = [(i, k, t, frozenset(w for w in line.lower().split(" ") if w)) for i, t in rows for k, line in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: (x[0], x[1]))
    gone = defaultdict(set)
    holders = defaultdict(set)
    for at, (i, k, t, words) in enumerate(lines):
        near = Counter(e for w in words for e in holders[w])
        for e, shared in near.items():
            if shared >= threshold * (len(words) + len(lines[e][3]) - shared) - 1e-9 and lines[e][:2] < (i, k):
                gone[i, t].add(k)
                break
        for w in words:
            holders[w].add(at)
    return gone


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_line_dedup_by_force(spark, kind):
    texts = cases.TEXTS if kind == "odd" else cases.documents()
    gone = lines_by_force(texts)
    want = Counter()
    for i, t in texts:
        t = t or ""
        lines, g = t.split("\n"), gone.get((i, t), set())
        want[i, len(lines), len(g), sha("\n".join(x for k, x in enumerate(lines) if k not in g).encode())] += 1
    docs = cases.table(spark, texts)
    assert Counter(map(tuple, line_dedup.line_digests(docs).collect())) == want
    assert Counter(map(tuple, line_dedup.line_digests(docs, broadcast_rows=0).collect())) == want
    kept = line_dedup.drop_similar_lines(docs)
    assert kept.columns == docs.columns
    texts_kept = Counter(sha((r.text or "").encode()) for r in kept.collect())
    assert texts_kept == Counter(w[3] for w in want.elements())


def test_line_dedup_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    want = Counter(duckdb.sql(line_dedup.ORACLE).fetchall())
    assert Counter(map(tuple, queries.op7_line_dedup(spark, cases.SF).collect())) == want


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.line_digests(cases.odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_sets_are_read_as_columns(spark):
    """Lambdas read columns, as what stands inside their call is interpreted; a text is hashed once, not for each of its lines."""
    sets = line_dedup.sets_of(id_and_text(spark.read.parquet(f"{cases.SF}/documents.parquet")), 0.8)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(transform|aggregate)\((array_remove|array_distinct|sort_array|slice)\(", plan)
    assert plan.index("Generate posexplode") < plan.index("xxhash64(text")
    bits = sets.selectExpr("size", "bit_count(even) + bit_count(odd) AS bits").where("size > 0")
    assert bits.count() and not bits.where("bits > size OR (size - bits) % 2 <> 0").count()


def repeats_by_force(texts, window):
    first, rows = {}, [(i, WORD.findall((t or "").encode())) for i, t in texts]
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = sha(b" ".join(w[k : k + window]))
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[sha(b" ".join(w[k : k + window]))] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


@pytest.mark.parametrize(("kind", "window"), [("odd", 50), ("given", 50), ("given", 31)])
def test_substrings_by_force(spark, kind, window):
    texts = cases.TEXTS if kind == "odd" else cases.documents()
    docs = cases.table(spark, texts)
    want = repeats_by_force(texts, window)
    assert Counter(map(tuple, substrings.drop_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want
    kept = substrings.without_repeats(docs, window)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, sha(b" ".join(WORD.findall((r.text or "").encode())))) for r in kept.collect()) == Counter((w[0], w[3]) for w in want.elements())


def test_every_shift_meets_the_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_empty_tables(spark):
    none = cases.empty(spark)
    assert simhash.near_duplicates(none).count() == 0
    assert line_dedup.line_digests(none).count() == 0
    assert substrings.drop_repeats(none).count() == 0
    assert substrings.without_repeats(none).count() == 0
