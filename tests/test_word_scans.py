"""Queries over words: texts are shuffled whole and once for each read, no words are, and each part is worked out once."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cadenza.functions import layout
from cadenza.operators import intervals, transcript
from cadenza.sources import bridge

DIR = "/root/testdata/sf0.001"
#: How often each query reads the texts.
READS = {
    "sentences": 1, "moment_titles": 1, "fit_layout": 1, "merge_word_pieces": 1, "range_union": 1, "remap_words": 2, "remap_keyframes": 2, "block_edits": 2,
    "snap_trim": 2, "scenes_left": 2, "track_remap": 2, "annotate_words": 2, "range_subtract": 2, "caption_at": 1,
}


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", READS)
def test_words_are_not_shuffled(spark, capsys, name):
    out = plan(__spark_entry__.queries()[name](spark, DIR), capsys)
    assert out.count("FileScan parquet") == READS[name]
    of_texts = out.count("REPARTITION_BY_NUM")
    others = sum("Exchange hashpartitioning" in x for x in out.split("\n")) - of_texts
    assert of_texts == READS[name] and (others == 0 or name == "range_subtract")  # that one shuffles ranges and cuts, by buckets of time


def test_parts_grow_with_what_is_read(spark, tmp_path):
    spark.range(64).repartition(64).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        read = spark.read.parquet(str(tmp_path / "t"))
        n = read.rdd.getNumPartitions()
        assert n > 1 and bridge.dealt(read, "id").rdd.getNumPartitions() == 8 * n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_widths_need_one_pattern_for_a_text(spark, capsys):
    text = spark.createDataFrame([("A",)], "t string").select(layout.text_em(F.upper("t")).alias("em"))
    assert plan(text, capsys).split("== Physical Plan ==")[1].count("regexp_replace") == 1


def test_widths_are_sums_over_characters(spark):
    texts = ["", "MONKEY", "a-b [c] ^ & \\ é", "ß🔥 🔥", "Ünïcode — “x” 100%", "".join(layout.WIDTHS), " 漢字ⅷ"]
    emoji = lambda c: ord(c) > 0x2000 and not (c.isalpha() or c.isnumeric())
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", layout.text_em(F.col("t")).alias("em")).collect()
    assert {r.t: r.em for r in rows} == {x: sum(layout.WIDTHS.get(c, layout.EMOJI_EM if emoji(c) else layout.OTHER_EM) for c in x) for x in texts}


def test_kept_and_subtract_against_milliseconds(spark):
    """Odd ranges: empty, turned, beyond the span, equal, touching and over several minutes; keys without cuts, spans without cuts and cuts without a span."""
    rnd = random.Random(5)
    some = lambda n, most, long: [(k, a, a + rnd.randint(-3, long)) for k in (1, 2) for a in (rnd.randint(-5, most) for _ in range(n))]
    cuts, spans = some(12, 90, 14) + [(1, 100, 100), (2, 100, 130), (9, 1, 5)], [(1, 3, 100), (2, 0, 100), (3, 0, 100), (4, 5, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "project_id long, a long, b long")
    want, base = [], {}
    for k, lo, hi in spans:
        free = [m for m in range(lo, hi) if not any(c == k and a <= m < b for c, a, b in cuts)]
        starts = [m for m in free if m - 1 not in free]
        for m in starts:
            end = next(x for x in range(m, hi + 1) if x not in free)
            want.append((k, m, end, base.get(k, 0)))
            base[k] = base.get(k, 0) + end - m
    got = intervals.kept(frame(cuts), spark.createDataFrame(spans, "project_id long, lo long, hi long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)

    long = lambda rows: [(k, a * 7001, b * 7001) for k, a, b in rows]
    ranges, cuts = long(some(9, 90, 40) + [(1, 10, 60), (1, 10, 60), (3, 0, 50), (3, 60, 60)]), long(some(14, 90, 12) + [(7, 0, 9)])
    want = set()
    for k, a, b in {r for r in ranges if r[2] > r[1]}:
        edges = sorted({a, b} | {x for c, y, z in cuts if c == k for x in (y, z) if a < x < b})
        parts = [[x, y] for x, y in zip(edges, edges[1:]) if not any(c == k and p <= x and y <= q for c, p, q in cuts)]
        whole = []
        for p in parts:
            if whole and whole[-1][1] == p[0]:
                whole[-1][1] = p[1]
            else:
                whole.append(p)
        want |= {(k, *p) for p in whole}
    assert {tuple(r) for r in intervals.subtract(frame(ranges), frame(cuts)).collect()} == want


def test_sentences_and_pieces_against_folds(spark):
    rnd = random.Random(3)
    rows = []
    for p in range(6):
        at = 0
        for i in range(90):
            at += rnd.choice([0, 0, 0, 700, 1300])
            rows.append((p, i, rnd.choice(["a", "-b", "c-", "-", "x." if p % 2 else "x", "d"]), at, at + 200))
            at += 200
    words = spark.createDataFrame(rows, "project_id long, idx long, word string, start_ms long, end_ms long")
    sents, pieces = {}, {}
    for p in range(6):
        own = [r for r in rows if r[0] == p]
        marks = sum(r[2][-1] in ".!?" for r in own)
        punctuated = marks >= max(3, len(own) // 40)
        out, now = [], []
        for k, r in enumerate(own):
            now.append(r)
            gap = own[k + 1][3] - r[4] if k + 1 < len(own) else 0
            if (r[2][-1] in ".!?" or gap > 1200) if punctuated else (gap > 600 or len(now) == 14):
                out.append(now)
                now = []
        sents[p] = [" ".join(r[2] for r in x) for x in [*out, now] if x]
        joined = []
        for r in own:
            if r[2].startswith("-") and joined:
                joined[-1] += r[2]
            else:
                joined.append(r[2])
        pieces[p] = joined
    got = transcript.sentences(words).orderBy("project_id", "sid").collect()
    assert {p: [r.text for r in got if r.project_id == p] for p in range(6)} == sents
    got = transcript.merge_pieces(words).orderBy("project_id", "idx").collect()
    assert {p: [r.word for r in got if r.project_id == p] for p in range(6)} == pieces


def test_layout_is_worked_out_from_rows(spark):
    rnd = random.Random(8)
    rows = [[round(rnd.uniform(300, 6000), 2) for _ in range(rnd.randint(0, 5))] for _ in range(60)]
    scale = lambda em: 1.0 if em * 126 / 1000 + 20 <= 920 else max(0.45, 900 / (em * 126 / 1000))
    row = lambda ws: sum(ws) + 278 * max(len(ws) - 1, 0)
    for ws, r in zip(rows, spark.createDataFrame([(k, ws) for k, ws in enumerate(rows)], "k int, ws array<double>").select("k", layout.fit_layout(F.col("ws")).alias("f")).orderBy("k").collect()):
        best, split = scale(row(ws)), None
        if best < 0.8 and len(ws) > 1:
            for k in range(1, len(ws)):
                x = scale(max(row(ws[:k]), row(ws[k:])))
                if x > best + 1e-9:
                    best, split = x, k
        assert math.isclose(r.f.scale, best, rel_tol=1e-12) and r.f.split == split


def test_lines_look_ahead_and_ticks_follow_from_starts(spark):
    rnd = random.Random(4)
    rows, at = [], {}
    for p in range(4):
        for i in range(70):
            start = at.get(p, -300) + rnd.choice([0, 10, 130, 700])
            rows.append((p, i, rnd.choice(["a", "b", "c.", "d"]), start, start + rnd.choice([0, 90, 300])))
            at[p] = start
    words = spark.createDataFrame(rows, "project_id long, idx long, word string, start_ms long, end_ms long")
    for most in (1, 4):
        want = []
        for p in range(4):
            now = []
            for r in [r for r in rows if r[0] == p]:
                if not now or len(now[-1]) == most or now[-1][-1][2] == "c.":
                    now.append([])
                now[-1].append(r)
            want += [(p, x[0][1], [r[2] for r in x]) for x in now]
        assert sorted(map(tuple, transcript.line_values(words, "word", most).collect())) == want
        assert sorted((r.project_id, r.first_idx, r.n) for r in transcript.caption_lines(words, most).collect()) == [(p, i, len(x)) for p, i, x in want]
    points = [(p, t) for p in range(4) for t in range(0, max(r[4] for r in rows if r[0] == p) + 1, 50)]
    ranges = words.select("project_id", "idx", "start_ms", "end_ms")
    hits = intervals.last_begun(spark.createDataFrame(points, "project_id long, t long"), ranges).where("hit is not null")
    assert sorted((r.project_id, r.t, r.idx) for r in intervals.begun_at_ticks(ranges, 50).collect()) == sorted((r.project_id, r.t, r.hit.idx) for r in hits.collect())
