"""Rules at the cases that plain data rarely reach, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import layout
from cadenza.operators import engagement, lifecycle, transcript

PERF = "id long, ticket_id long, video_kind string, video_id long, platform string, views long, follows long, saves long, sends long"
TICKETS = "id long, stage string, angle string, clip_url string, hook_text string"


def test_kpis_sum_rows_without_any_id(spark):
    perf = spark.createDataFrame([(1, 4, None, None, "tt", 1005, 0, 0, 0), (2, None, "clip", 9, "tt", 1006, 0, 0, 0), (3, None, None, None, "tt", 7, 0, 1, 0)], PERF)
    tickets = spark.createDataFrame([(4, "posted", "a", None, "")], TICKETS)
    assert tuple(engagement.kpis(perf, tickets).first()) == (2, 1, 2018, 0, 1, 0)


def test_angle_scores_are_not_truncated(spark):
    perf = spark.createDataFrame([(1, 4, None, None, "tt", 1005, 0, 0, 0), (2, 4, None, None, "yt", 1006, 0, 0, 0)], PERF)
    tickets = spark.createDataFrame([(4, "posted", "a", None, ""), (5, "posted", "b", None, "")], TICKETS)
    assert {tuple(r) for r in engagement.angle_rollup(perf, tickets).collect()} == {("a", 1, 1.01), ("b", 0, 0.0)}


def test_a_hook_of_blanks_is_none(spark):
    tickets = spark.createDataFrame([(1, "ready", "a", None, " \n"), (2, "ready", "a", None, ""), (3, "ready", "a", None, "x")], TICKETS)
    beats = spark.createDataFrame([(1, 0, " ", False), (2, 0, "said", False), (2, 1, "", True), (3, 0, " ", False)], "ticket_id long, order_index long, spoken_line string, is_proof_beat boolean")
    assert {r.id: r.score for r in lifecycle.reel_score(tickets, beats).collect()} == {1: 73, 2: 82, 3: 79}


def test_the_first_beat_of_a_ticket_is_0(spark):
    tickets = spark.createDataFrame([(1,), (2,)], "id long")
    beats = spark.createDataFrame([(1, 4), (1, 2)], "ticket_id long, order_index long")
    assert {tuple(r) for r in lifecycle.next_ordinal(tickets, beats).collect()} == {(1, 5), (2, 0)}


def test_reels_come_first_among_equal_scores(spark):
    """A clip with markers or of a caption project is a reel like a ticket's."""
    clips = spark.createDataFrame([(1, 1, "rendered", None), (2, 1, "rendered", "[]"), (3, 2, "rendered", ""), (4, 1, "suggested", "")], "id long, project_id long, status string, markers string")
    projects = spark.createDataFrame([(1, "moments"), (2, "caption")], "id long, mode string")
    tickets = spark.createDataFrame([(9, "posted", "a", "/x", "")], TICKETS)
    videos = engagement.universe(clips, tickets, projects)
    got = [(r.kind, r.vid, r.is_reel) for r in engagement.video_pivot(spark.createDataFrame([], PERF), videos).collect()]
    assert got == [("clip", 2, True), ("clip", 3, True), ("reel", 9, True), ("clip", 1, False)]


def test_lost_exports(spark):
    clips = spark.createDataFrame([(1, "rendering", "Cutting"), (2, "rendered", "x"), (3, None, None)], "id long, status string, stage string")
    assert [tuple(r) for r in lifecycle.recover_renders(clips).orderBy("id").collect()] == [(1, "error", "", lifecycle.RENDER_LOST, True), (2, "rendered", "x", None, False), (3, None, None, None, False)]


def filled_by_hand(text, most):
    lines = []
    for para in text.replace("\r", "").split("\n"):
        cur = ""
        for word in para.split():
            if cur and len(f"{cur} {word}") > most:
                lines.append(cur)
                cur = word
            else:
                cur = f"{cur} {word}".strip()
        lines.append(cur)
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


@pytest.mark.parametrize("most", [1, 5, 18])
def test_titles_of_any_length(spark, most):
    texts = ["", " \n ", "one", "a verylongwordthatdoesnotfit b", "exactly eighteen c x", "a\n\n b \r\n", "tab\tand no-break space\x1fend", "\U0001f600 " * 30, "fits it  fits   it", "wörd " * 20_000, "no-blank" * 5_000, "x" * 18 + " " + "y" * 19 + " z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.lines for r in df.select("k", layout.wrapped(F.col("t"), most).alias("lines")).collect()}
    assert got == {k: filled_by_hand(t, most) for k, t in enumerate(texts)}


def test_candidates_of_many_short_sentences(spark):
    """Sentences of 50 ms: 300 of them fill 15 s, so a bound by their number would lose candidates."""
    rows = [(1, k, k * 50, k * 50 + 50) for k in range(1300)] + [(2, 0, 0, 400)]
    s = spark.createDataFrame(rows, "project_id long, sid long, start_ms long, end_ms long")
    want = set()
    for i in range(1300):
        for target in (30_000, 50_000):
            fits = [(abs(50 * (j - i + 1) - target), j) for j in range(i, 1300) if 15_000 <= 50 * (j - i + 1) <= 60_000]
            if fits:
                j = min(fits)[1]
                want.add((1, i, j, i * 50, j * 50 + 50))
    assert {tuple(r) for r in transcript.candidates(s).collect()} == want | {(2, 0, 0, 0, 400)}


def test_sentences_are_made_once(spark):
    """Candidates and features each read the sentences that they are given once, whatever those cost."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        made.add(1)
        return k

    text = F.concat(F.lit("You said "), F.col("id"), F.lit("."))
    sents = spark.range(100).select(F.lit(1).cast("long").alias("project_id"), seen("id").alias("sid"), (F.col("id") * 5000).alias("start_ms"), (F.col("id") * 5000 + 4900).alias("end_ms"), text.alias("text"), F.lit(3).cast("long").alias("n"))
    found = transcript.candidates(sents)
    assert found.count() > 100 and made.value == 100
    assert transcript.features(sents, found).count() == found.count() and made.value == 200
