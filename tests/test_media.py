"""Files, gates, error classes, finders, timings and titles, worked by hand."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import finders, intervals, lifecycle, matching, media, scripts, subtitles
from cadenza.sources.bridge import BRAND_SCHEMA

WORDS = "project_id long, idx long, word string, start_ms long, end_ms long"


def test_files_change_the_gates(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in (("fine.mp4", 20_000), ("small.mp4", 9_999), ("sub/deep.mp4", 10_000), ("scene.mp4", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = media.listing(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.size) for r in files.collect()} == {("fine.mp4", 20_000), ("small.mp4", 9_999), ("deep.mp4", 10_000), ("scene.mp4", 1)}
    at = lambda n: str(tmp_path / n)
    rows = [(1, at("fine.mp4"), 30.0, 5), (2, at("gone.mp4"), 30.0, 5), (3, at("small.mp4"), 30.0, 5), (4, at("sub/deep.mp4"), 2.5, 5), (5, at("fine.mp4"), 180.6, 5), (6, at("fine.mp4"), None, 0), (7, None, 9.0, 1), (8, at("fine.mp4"), 3.0, 1)]
    got = {r.id: r.reason for r in media.reel_gate(spark.createDataFrame(rows, "id long, path string, duration double, n_words long"), files).collect()}
    assert got == {1: None, 2: media.NO_FILE, 3: media.SMALL_FILE, 4: "duration 2s is outside platform bounds (3–180s)", 5: "duration 181s is outside platform bounds (3–180s)", 6: media.NO_CAPTIONS, 7: media.NO_FILE, 8: None}
    config = spark.createDataFrame([("en", 3, "hands_off", False, [], [], False, [])], BRAND_SCHEMA)
    tickets = spark.createDataFrame([(k, "en", "staged", "native-short", True, None, 0, None) for k in (1, 2)], "id long, brand string, stage string, capture_mode string, autopilot boolean, gate string, tries int, failure string")
    beats = spark.createDataFrame([(1, 1, at("scene.mp4")), (2, 2, at("scene.mp4")), (3, 2, at("nowhere.mp4"))], "id long, ticket_id long, clip_path string")
    outcome = lambda b: {r.id: r.outcome for r in lifecycle.tick_outcome(tickets, b, config).collect()}
    assert outcome(beats) == {1: "advanced", 2: "advanced"} and outcome(media.lacking(beats, files)) == {1: "advanced", 2: "footage"}


@pytest.mark.parametrize("most", [2000, 3])
def test_the_first_class_of_an_error_wins(spark, most):
    said = ["HTTP 403: Sign in to confirm you're not a bot", "Requested format is not available (403)", "Forbidden", "READ TIMED OUT", "private video", "", None, "403", "connection reset, please try again"]
    errors = spark.createDataFrame(list(enumerate(said)), "id long, message string")
    got = {r.id: r["class"] for r in media.classified(errors, media.marker_table(spark), most=most).collect()}
    assert [got[k] for k in range(9)] == ["bot_challenge", "format_unavailable", "blocked", "transient", None, None, None, "blocked", "blocked"]


def test_worker_messages(spark):
    df = spark.createDataFrame([(1, "no disk", ["a"]), (-11, "", []), (0xC0000005, None, ["x"]), (2, None, ["a", "", "b", "c"]), (3, "", [])], "code long, reason string, tail array<string>")
    got = [r.m for r in df.select(media.worker_message(F.col("code"), F.col("reason"), F.col("tail")).alias("m")).collect()]
    assert got == ["no disk", "transcription crashed inside the runtime (exit -11)", "transcription crashed inside the runtime (exit 3221225477)", "transcription failed (exit 2): b / c", "transcription failed (exit 3)"]


def test_expressions_of_shots_and_filters(spark):
    shots = spark.createDataFrame([(1, 0, 0.0), (1, 1500, 0.5), (1, 2250, 1.0), (2, 0, 0.5)], "track_id long, start_ms long, center double")
    assert {r.track_id: r.expr for r in media.x_expression(shots, 1920, 608).collect()} == {1: "if(lt(t,1.500),0,if(lt(t,2.250),656,1312))", 2: "656"}
    one = spark.range(1).select(
        media.voice_pad(F.lit(5.5), F.lit(4.25)).alias("a"), media.voice_pad(F.lit(4.3), F.lit(4.25)).alias("b"), media.chained(F.lit("x"), F.lit(""), F.lit(None).cast("string"), F.lit("y")).alias("c"),
        *[media.frame_rate(F.lit(r)).alias(f"r{k}") for k, r in enumerate(["30000/1001", "24", "0/0", "-3", "x/2", "24/", None])], media.output_size(F.lit(1081), F.lit(9), F.lit(16)).alias("s"),
        media.object_position(F.lit(0.5), F.lit(16 / 9)).alias("p0"), media.object_position(F.lit(0.9), F.lit(16 / 9)).alias("p1"), media.object_position(F.lit(0.9), F.lit(0.5)).alias("p2"),
        media.track_covers(F.lit(40), F.lit(960), F.lit(0), F.lit(1000)).alias("t0"), media.track_covers(F.lit(60), F.lit(960), F.lit(0), F.lit(1000)).alias("t1"), media.track_covers(F.lit(None), F.lit(1), F.lit(0), F.lit(1)).alias("t2"),
    ).first()
    assert (one.a, one.b, one.c) == ("tpad=stop_mode=clone:stop_duration=1.250", "", "x,y")
    assert [round(one[f"r{k}"], 3) for k in range(7)] == [29.97, 24, 30, 30, 30, 24, 30] and tuple(one.s) == (1080, 1922)
    assert (one.p0, one.p1, one.p2) == (50, 100, 50) and (one.t0, one.t1, one.t2) == (True, False, False)


def test_small_rules(spark):
    d = F.lit
    one = spark.range(1).select(
        *[media.preview_center(*map(d, x)).alias(f"c{k}") for k, x in enumerate([(0.7, 0.5, 0.50005), (0.7, 0.5, 0.6), (None, 0.5, 0.5)])],
        *[media.big_captions(*map(d, x)).alias(f"b{k}") for k, x in enumerate([(120, 3), (119, 3), (126, 4), (None, 2)])],
        *[scripts.scenes_asked(d(x)).alias(f"s{k}") for k, x in enumerate(["1", "2.5", "7", "900", "x", "NaN", None])],
    ).first()
    assert list(one) == [0.7, 0.6, 0.5, True, False, False, False, 2, 3, 7, 12, 5, 5, 5]


def test_timings_never_fall(spark):
    rows = [(1, 0, -1.0, 0.5), (1, 1, 2.0, 1.0), (1, 2, 1.0, 3.0), (1, 3, None, None), (1, 4, 9.0, 12.0), (2, 0, 1.23456, 1.24)]
    df = spark.createDataFrame([(*r, 10.0 if r[0] == 1 else 1.0) for r in rows], "id long, k long, start double, end double, duration double")
    got = sorted(tuple(r)[:4] for r in intervals.monotone(df, "id", "k", "duration").collect())
    assert got == [(1, 0, 0.0, 0.5), (1, 1, 2.0, 2.02), (1, 2, 2.0, 3.0), (1, 3, 2.0, 2.02), (1, 4, 9.0, 10.0), (2, 0, 1.0, 1.0)]


def test_finders_take_over(spark):
    words = spark.createDataFrame([(p, 0, "x", 0, 400) for p in range(4)], WORDS)
    clip = lambda w, keep: w.where(keep).select("project_id", "start_ms", "end_ms", *[F.lit(1.0).alias(c) for c in ("start", "end", "score")], *[F.lit("t").alias(c) for c in ("title", "hook", "reason")])
    asked = []

    def strict(w):
        asked.append(sorted(r[0] for r in w.select("project_id").collect()))
        return clip(w, "project_id = 2")

    def rest(w):
        asked.append(sorted(r[0] for r in w.select("project_id").collect()))
        return clip(w, "project_id < 2")

    broken = lambda w: clip(w, F.raise_error(F.lit("out of quota")).cast("boolean"))
    order = ["strict", "broken", "absent", "rest"]
    found, failures = finders.find(words, order, {"strict": strict, "broken": broken, "rest": rest})
    assert asked == [[0, 1, 2, 3], [0, 1, 3]]
    assert {(r.project_id, r.finder) for r in found.collect()} == {(0, "rest"), (1, "rest"), (2, "strict")}
    why = {(r.project_id, r.finder): r.reason for r in failures.collect()}
    assert set(why) == {(p, f) for p in (0, 1, 3) for f in order[:3]} | {(3, "rest")}
    assert why[3, "strict"] == "strict: returned no clips" and "out of quota" in why[0, "broken"] and why[1, "absent"] == "absent: LookupError: no finder absent"
    (told,) = finders.messages(failures, order).collect()
    assert told.project_id == 3 and told.error.startswith("moment analysis failed after trying strict, broken, absent, rest. broken: ") and told.error.endswith("rest: returned no clips")


def test_fallback_orders():
    assert [finders.fallback_order(x) for x in ("claude", "ollama", "heuristic", "?")] == [["claude", "ollama", "heuristic"], ["ollama", "heuristic"], ["heuristic"], ["ollama", "heuristic"]]


def test_titles_and_clip_windows_in_subtitles(spark):
    words = spark.createDataFrame([(1, 0, "before", 0, 400), (1, 1, "over", 900, 1300), (1, 2, "inside.", 1300, 1700), (1, 3, "after", 4000, 4400)], WORDS)
    title = "struct<text:string,place:string,style:string,start:double,duration:double>"
    clips = spark.createDataFrame([(1, 1000, 3000, ("A {big} title", "top", "glow", 0.5, 3.0)), (1, 3500, 5000, (" ", "top", "bold", 0.0, 1.0)), (1, 9000, 9900, ("Alone", "left", "bold", 0.0, 0.6))], f"project_id long, a long, b long, title {title}")
    got = {r.clip: r.text for r in subtitles.clip_subtitles(words, clips, preset="capcut").collect()}
    events = {k: [x for x in v.split("\n") if x.startswith("Dialogue")] for k, v in got.items()}
    assert len(events[1000]) == 4 and events[1000][0].startswith("Dialogue: 0,0:00:00.00,0:00:00.30,Base,,0,0,0,,") and "over" in events[1000][0] and "before" not in got[1000]
    assert events[1000][2:] == [
        r"Dialogue: 1,0:00:00.50,0:00:03.50,TitleGlow,,0,0,0,,{\fad(400,400)\blur14\fscx86\fscy86\t(0,460,\fscx100\fscy100)}A (big)\Ntitle",
        r"Dialogue: 2,0:00:00.50,0:00:03.50,Title,,0,0,0,,{\fad(400,400)\fscx86\fscy86\t(0,460,\fscx100\fscy100)}A (big)\Ntitle",
    ]
    styles = [x for x in got[1000].split("\n") if x.startswith("Style: Title")]
    assert styles == ["Style: TitleGlow,Arial,138,&H00FFFFFF,&H00FFFFFF,&H4000D4FF,&H00000000,1,0,0,0,100,100,1,0,1,20,0,8,64,64,192,1", "Style: Title,Arial,138,&H00FFFFFF,&H00FFFFFF,&H00000000,&HA0000000,1,0,0,0,100,100,1,0,1,4,4,8,64,64,192,1"]
    assert "Title" not in got[3500] and len(events[3500]) == 1
    assert events[9000] == [r"Dialogue: 1,0:00:00.00,0:00:00.60,Title,,0,0,0,,{\fad(150,150)\fscx86\fscy86\t(0,210,\fscx100\fscy100)}Alone"] and "Style: Title,Arial,119," in got[9000]


def test_tracks_of_more_than_forty_shots(spark):
    """Of 60 shots the 20 that move least go, each time the first of equals, as a fold by hand does."""
    centers = [((k * 7) % 60) / 60 if k % 2 else 1 - ((k * 11) % 60) / 60 for k in range(60)]
    kept = []
    for k, c in enumerate(round(x, 4) for x in centers):
        if not kept or abs(c - kept[-1][1]) >= 0.05:
            kept.append((k * 1000, c))
    assert len(kept) > 45
    while len(kept) > 40:
        moves = [(abs(kept[k][1] - kept[k - 1][1]), k) for k in range(1, len(kept))]
        del kept[min(moves)[1]]
    shots = spark.createDataFrame([(1, k * 1000, c) for k, c in enumerate(centers)], "track_id long, start_ms long, center double")
    assert [(r.start_ms, r.center) for r in matching.folded_shots(shots).orderBy("start_ms").collect()] == kept
