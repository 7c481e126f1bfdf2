"""Small fixtures with results worked out by hand."""

from pyspark.sql import functions as F

from cadenza.functions.layout import crop_window, text_em
from cadenza.functions.scoring import perf_score
from cadenza.operators import engagement, intervals, lifecycle, transcript


def ranges(spark, rows):
    return spark.createDataFrame([(1, a, b) for a, b in rows], "project_id long, a long, b long")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_perf_score(spark):
    df = spark.createDataFrame([(1000, 2, 3, 4), (None, None, None, None)], "views int, follows int, saves int, sends int")
    assert [r[0] for r in df.select(perf_score()).collect()] == [28.0, 0.0]


def test_merge_and_kept(spark):
    assert pairs(intervals.merged(ranges(spark, [(5000, 6000), (1000, 2000), (2000, 3000), (5500, 7000)])), "a", "b") == [(1000, 3000), (5000, 7000)]
    span = spark.createDataFrame([(1, 0, 10000)], "project_id long, lo long, hi long")
    kept = intervals.kept(ranges(spark, [(2000, 3000), (2500, 4000), (9000, 12000), (5000, 5000)]), span)
    assert pairs(kept, "a", "b", "base") == [(0, 2000, 0), (4000, 9000, 2000)]
    words = spark.createDataFrame([(1, 0, 1500, 2500), (1, 1, 2200, 3800), (1, 2, 3500, 4500), (1, 3, 8900, 9500)], "project_id long, idx long, start_ms long, end_ms long")
    assert pairs(intervals.remapped(words, kept), "idx", "new_start", "new_end") == [(0, 1500, 2000), (2, 2000, 2500), (3, 6900, 7000)]
    assert pairs(intervals.kept(ranges(spark, []), span), "a", "b") == [(0, 10000)]


def test_subtract_and_uncovered(spark):
    assert pairs(intervals.subtract(ranges(spark, [(0, 10000)]), ranges(spark, [(3000, 5000)])), "a", "b") == [(0, 3000), (5000, 10000)]
    assert pairs(intervals.uncovered(ranges(spark, [(400, 700), (4400, 4600)]), ranges(spark, [(400, 700)])), "a", "b") == [(4400, 4600)]


def test_as_of(spark):
    steps = spark.createDataFrame([(1, 10, 0.65), (1, 15, 0.5), (1, 26, 0.86)], "k long, start long, value double")
    points = spark.createDataFrame([(1, 10), (1, 14), (1, 15), (1, 30), (1, 2), (2, 5)], "k long, t long")
    assert pairs(intervals.as_of(points, steps, "k"), "k", "t", "center") == [(1, 2, 0.65), (1, 10, 0.65), (1, 14, 0.65), (1, 15, 0.5), (1, 30, 0.86), (2, 5, 0.5)]


def test_pieces_and_pauses(spark):
    w = spark.createDataFrame([(1, 0, "decision", 400, 900), (1, 1, "-maker", 900, 1300), (1, 2, "all", 3000, 3200)], "project_id long, idx long, word string, start_ms long, end_ms long")
    merged = transcript.merge_pieces(w)
    assert pairs(merged, "word", "start_ms", "end_ms") == [("all", 3000, 3200), ("decision-maker", 400, 1300)]
    assert pairs(transcript.merge_pieces(merged), "word", "start_ms") == pairs(merged, "word", "start_ms")
    assert pairs(transcript.pause_cuts(w), "a", "b") == [(1450, 2850)]


def test_unpunctuated_sentences_use_the_pause_band(spark):
    w = spark.createDataFrame([(1, k, "w", k * 500 + (400 if k > 4 else 0), k * 500 + 400 + (400 if k > 4 else 0)) for k in range(40)], "project_id long, idx long, word string, start_ms long, end_ms long")
    sizes = [r.n for r in transcript.sentences(w).orderBy("sid").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 14


def test_layout(spark):
    assert spark.range(1).select(text_em(F.lit("MONKEY"))).first()[0] == 833 + 778 + 722 + 722 + 667 + 667
    c = spark.range(1).select(*[crop_window(F.lit(1920), F.lit(1080), 9, 16, F.lit(x)).alias(f"c{k}") for k, x in enumerate((0.5, 0.0, 1.0))]).first()
    assert [(r.w, r.h, r.x) for r in c] == [(608, 1080, 656), (608, 1080, 0), (608, 1080, 1312)]


def test_kpis_without_numbers(spark):
    perf = spark.createDataFrame([], "id long, ticket_id long, video_kind string, video_id long, platform string, views long, follows long, saves long, sends long, captured_at timestamp")
    tickets = spark.createDataFrame([(1, "posted"), (2, "ready"), (3, "ready")], "id long, stage string")
    assert tuple(engagement.kpis(perf, tickets).first()) == (3, 1, 0, 0, 0, 0)


def test_legacy_key(spark):
    perf = spark.createDataFrame([(1, 7, None, None), (2, None, None, None)], "id long, ticket_id long, video_kind string, video_id long")
    assert pairs(engagement.keyed(perf), "kind", "vid") == [("reel", 7)]


def test_stage_machine(spark):
    t = spark.createDataFrame([(1, "ready"), (2, "posted"), (3, "other")], "id long, stage string")
    assert [r.next_stage for r in lifecycle.plan_next(t).orderBy("id").collect()] == ["scheduled", None, None]
