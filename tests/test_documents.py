"""JSON sources, replies and subtitle files, by hand."""

import json

from pyspark.sql import functions as F

from cadenza.operators import lifecycle, subtitles
from cadenza.operators.scripts import SOUNDS
from cadenza.sources import documents, replies


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_transcripts(spark, tmp_path):
    for p, text in ((3, json.dumps([{"start": 0.4, "end": 0.9, "word": " Hi"}, {"start": 1.0, "end": None, "word": "x"}, {"start": 1.25, "end": 1.5, "word": "you"}])), (4, "[]"), (5, '[{"start": 0.4, "wo'), (6, "")):
        (tmp_path / str(p)).mkdir()
        (tmp_path / str(p) / "words.json").write_text(text)
    got = documents.transcripts(spark, f"{tmp_path}/*/words.json").orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(3, 0, " Hi", 400, 900), (3, 2, "you", 1250, 1500)]
    assert documents.transcripts(spark, f"{tmp_path}/nothing/words.json").collect() == []


def test_brand_files(spark, tmp_path):
    (tmp_path / "b-two.json").write_text(json.dumps({"name": "Two", "autonomy": "semi", "cadence": {"reels_per_week": 5, "platforms": ["tt"]}, "angle_library": ["a", " "], "hook_seeds": ["", "Why?", " "], "voice": {"banned_phrases": ["Never"]}, "proof_rules": True, "feed": True, "more": 1}))
    (tmp_path / "a-one.json").write_text("{}")
    (tmp_path / "broken.json").write_text('{"name": "x", ')
    config = documents.brand_files(spark, str(tmp_path))
    assert [r.brand for r in config.collect()] == ["a-one", "Two"]
    every = lifecycle.settled(documents.configured(spark.createDataFrame([("Two",), ("a-one",), ("other",)], "brand string"), config))
    assert {r.brand: r.hook_seeds for r in every.collect()} == {"Two": ["Why?"], "a-one": [], "other": []}
    got = {r.brand: (r.target, r.level, r.feed, r.angles, r.banned, r.cadence_platforms) for r in every.collect()}
    assert got["Two"] == (5, "semi", True, ["a"], ["Never"], ["tt"])
    assert got["a-one"] == got["other"] == (3, "supervised", False, [], [], [])
    assert documents.brand_files(spark, f"{tmp_path}/nothing").collect() == []


def test_replies(spark):
    assert one(spark, replies.json_object, 'Sure: ```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, replies.json_object, "no object") is None
    clip = '{"start": 1, "end": 2.5, "title": "t"}'
    for text in (f"[{clip}]", '{"note": "x", "clips": [' + clip + "]}", clip, f"Here you are: [{clip}] bye"):
        assert [(c.start, c.end, c.title) for c in one(spark, replies.clips, text)] == [(1.0, 2.5, "t")]
    assert one(spark, replies.clips, "nothing") == []
    assert one(spark, replies.strings, '```\n["a ", "", "b"]\n```') == ["a", "b"]
    assert one(spark, replies.strings, '1. "First one"\n- second\n\n') == ["First one", "second"]
    meta = one(spark, replies.post_meta, '{"tt": {"caption": "c", "hashtags": ["#a", "#b"]}, "yt": {"title": "t", "tags": "x, y"}}')
    assert (meta["tt"].caption, meta["tt"].hashtags, meta["ig"].caption, meta["yt"].title, meta["yt"].tags) == ("c", "#a #b", "", "t", "x, y")


def test_suggestions(spark):
    text = json.dumps({"emphasis": [0, 2, 9, -1, 1], "emoji": {"1": "X", "x": "Y", "8": "Z", "2": " "}, "zoom": [2, 1, 0], "sfx": [{"index": 1, "name": "pop"}, {"index": 1, "name": "boom"}, {"index": 7, "name": "ding"}]})
    r = replies.suggestions(spark.createDataFrame([(1, text, 3)], "id long, text string, n int"), SOUNDS).first()
    assert (r.emphasis, r.emoji, r.zoom, [tuple(x) for x in r.sfx]) == ([0, 2, 1], {"1": "X"}, [2, 1, 0], [(1, "pop")])


def test_subtitle_parts(spark):
    t = spark.createDataFrame([(59.999,), (3661.5,), (-1.0,)], "s double")
    assert [r[0] for r in t.select(subtitles.time_of(F.col("s"))).collect()] == ["0:00:60.00", "1:01:01.50", "0:00:00.00"]
    assert one(spark, subtitles.colour, "#FFD400") == "&H00D4FF&"
    assert one(spark, lambda c: subtitles.colour(c, "00"), "#fd4") == "&H0044DDFF"
    assert one(spark, subtitles.escaped, "a\\b{c}\r\nd") == "a∖b(c)\\Nd"
    assert subtitles.style("capcut", {"size": 50, "nothing": 1, "outline": None})["size"] == 50
    assert subtitles.style("unknown") == subtitles.style("capcut")


def test_subtitle_file(spark):
    w = spark.createDataFrame([(1, 0, "the", 0, 400), (1, 1, "cat", 400, 410), (1, 2, "gratification", 900, 1300), (1, 3, "monkey", 1300, 1700)], "project_id long, idx long, word string, start_ms long, end_ms long")
    text = subtitles.subtitles(w).first().text
    events = [x for x in text.split("\n") if x.startswith("Dialogue")]
    on, off = "{\\1c&H00D4FF&\\fscx112\\fscy112}", "{\\1c&HFFFFFF&\\fscx100\\fscy100}"
    assert text.startswith("[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\n") and text.endswith("\n")
    assert "Style: Base,Arial,126,&H00FFFFFF,&H00FFFFFF,&H00000000,&H90000000,1,0,0,0,100,100,0,0,1,10,0,5,80,80,0,1\n\n[Events]\n" in text
    assert events[0] == f"Dialogue: 0,0:00:00.00,0:00:00.40,Base,,0,0,0,,{on}THE{off} CAT"
    assert events[1] == f"Dialogue: 0,0:00:00.40,0:00:00.45,Base,,0,0,0,,THE {on}CAT{off}"
    assert events[3] == "Dialogue: 0,0:00:01.30,0:00:01.70,Base,,0,0,0,,{\\fs102}GRATIFICATION\\N" + f"{on}MONKEY{off}"
