"""Streams run to the end of what is there, and once more after new files land."""

import json

from pyspark.sql import functions as F

from cadenza.streaming import lifecycle, perf


def fact(id_, vid, views, day, platform="tt"):
    return json.dumps({"id": id_, "video_kind": "clip", "video_id": vid, "platform": platform, "views": views, "follows": 0, "saves": 1, "sends": 0, "captured_at": f"2024-01-{day:02d}T10:00:00Z"})


def test_the_last_fact_of_a_video_and_platform_wins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([fact(1, 7, 10, 2), fact(2, 7, 20, 3), fact(3, 8, 5, 2), fact(9, 7, 1, 1, "yt")]))

    def run():
        perf.start_upserts(perf.facts(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
        return sorted((r.vid, r.platform, r.views) for r in perf.current(spark, str(tmp_path / "log")).collect())

    assert run() == [(7, "tt", 20), (7, "yt", 1), (8, "tt", 5)]
    (tmp_path / "in" / "b.json").write_text("\n".join([fact(4, 8, 50, 4), fact(5, 7, 15, 1)]))  # the second is older than what is there
    assert run() == [(7, "tt", 20), (7, "yt", 1), (8, "tt", 50)]


def test_daily_sums(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([fact(1, 7, 10, 2), fact(2, 7, 20, 2), fact(3, 8, 5, 3)]))
    q = perf.daily(perf.facts(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.day, r.views, r.score) for r in spark.table("days").collect()) == [("2024-01-02", 30, 6.03), ("2024-01-03", 5, 3.005)]


def test_takes_land_once_in_order(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name in ("b.mp4", "a.MOV", "c.txt"):
        (box / name).write_bytes(b"x")
    (box / "empty.mp4").write_bytes(b"")

    def run():
        lifecycle.land(lifecycle.takes(spark, str(box)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return sorted((r.batch_id, r.filename) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "a.MOV"), (0, "b.mp4")]
    (box / "d.mkv").write_bytes(b"xy")
    assert run() == [(0, "a.MOV"), (0, "b.mp4"), (1, "d.mkv")]


def test_tries_until_parked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, "sourced", 1, "broke"), (1, "sourced", 2, "broke"), (1, "sourced", 3, "broke again"), (2, "sourced", 1, "x"), (2, "sourced", 2, None), (2, "sourced", 3, "y")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ticket_id": t, "stage": s, "at": f"2024-01-01T00:0{m}:00Z", "error": e}) for t, s, m, e in rows))
    stream = spark.readStream.schema("ticket_id long, stage string, at timestamp, error string").json(str(tmp_path / "in"))
    q = lifecycle.tries(stream).writeStream.format("memory").queryName("tries").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.ticket_id, r.at.minute, r.tries, r.last_error, r.parked) for r in spark.table("tries").collect())
    assert got == [(1, 1, 1, "broke", False), (1, 2, 2, "broke", False), (1, 3, 3, "broke again", True), (2, 1, 1, "x", False), (2, 2, 0, None, False), (2, 3, 1, "y", False)]


def test_sheet_rows(spark, tmp_path):
    given = spark.createDataFrame([(2, 5, None, None, "tt", 10, 0, 1, 0, "2024-01-02 00:00:00"), (1, None, "clip", 3, "fb", 5, 0, 0, 2, "2024-01-03 00:00:00")], "id long, ticket_id long, video_kind string, video_id long, platform string, views long, follows long, saves long, sends long, captured_at string").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    videos = spark.createDataFrame([("reel", 5, "en", "hook", "angle 1", "")], "kind string, vid long, brand string, hook string, angle string, caption_style string")
    rows = perf.sheet_rows(given, videos)
    got = [json.loads(r.value) for r in rows.collect()]
    assert [list(r) for r in got] == [perf.ROW_FIELDS] * 2
    assert [(r["date"], r["platform"], r["brand"], r["hook"], r["views"], r["sends"]) for r in got] == [("2024-01-02", "TikTok", "en", "hook", 10, 0), ("2024-01-03", "fb", "", "", 5, 2)]
    push = lambda target: perf.push_rows(rows, target, "all", str(tmp_path / "staging"))
    assert push(None) == {"batch": "all", "rows": 2, "pushed": 0, "live": False}
    for pushed in (2, 0):  # the same batch again sends nothing
        assert push(str(tmp_path / "sheet")) == {"batch": "all", "rows": 2, "pushed": pushed, "live": True}
        assert len(spark.read.text(str(tmp_path / "sheet")).collect()) == 2
