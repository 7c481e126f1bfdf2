"""The domain's rules on small fixtures, worked out by hand."""

from pyspark.sql import functions as F

from cadenza.functions import layout
from cadenza.operators import lifecycle, matching, scripts, transcript
from cadenza.sources.bridge import BRAND_SCHEMA, COPY

TICKET = "id long, brand string, stage string, angle string, hook_text string, capture_mode string, clip_url string, autopilot boolean, auto_voiceover boolean, gate string, tries int, failure string"
BEAT = "id long, ticket_id long, order_index long, spoken_line string, on_screen_text string, caption string, clip_path string, voiceover_path string, is_proof_beat boolean"


def ticket(id_, stage="outlier", brand="en", **kw):
    base = {"angle": "an angle", "hook_text": "a hook", "capture_mode": "native-short", "clip_url": None, "autopilot": True, "auto_voiceover": False, "gate": None, "tries": 0, "failure": None}
    return (id_, brand, stage, *(base | kw).values())


def beats(spark, rows):
    return spark.createDataFrame([(k, t, k, said, shown, said, clip, vo, proof) for k, (t, said, shown, clip, vo, proof) in enumerate(rows)], BEAT)


def words(spark, texts, step=400):
    rows, t = [], 0
    for p, text in texts.items():
        for k, w in enumerate(text.split()):
            rows.append((p, k, w, t, t + step))
            t += step + (300 if w[-1] in ".!?" else 0)
        t = 0
    return spark.createDataFrame(rows, "project_id long, idx long, word string, start_ms long, end_ms long")


def test_next_step(spark):
    t = spark.createDataFrame([ticket(k, auto_voiceover=k == 4) for k in range(1, 6)] + [ticket(6, capture_mode="repurpose"), ticket(7, clip_url="/x.mp4")], TICKET)
    b = beats(spark, [(2, "a", "", "c", None, False), (2, "b", "", "", None, False)] + [(k, "a", "", "c", "v" if k == 5 else None, False) for k in (3, 4, 5)])
    assert {r.id: r.step for r in lifecycle.next_step(t, b).collect()} == {1: "script", 2: "clips", 3: "voice", 4: "build", 5: "build", 6: "footage", 7: "done"}


def test_script_gate_gives_the_first_reason(spark):
    config = spark.createDataFrame([("en", 3, "off", False, [], ["Never Say"], True, [])], BRAND_SCHEMA)
    t = spark.createDataFrame([ticket(1), ticket(2, hook_text=" "), ticket(3), ticket(4), ticket(5), ticket(6), ticket(7, brand="other")], TICKET)
    long_, fine = "word " * 301, "word " * 20
    b = beats(spark, [(2, fine, "", "", None, False), (3, fine, "never", "", None, False), (3, "say it", "never say", "", None, False), (4, fine, "in 3 days", "", None, False), (5, "too short", "", "", None, False), (6, long_, "", "", None, False), (7, fine + "3", "", "", None, False)])
    got = {r.ticket_id: r.reason for r in lifecycle.script_gate(t, b, config).collect()}
    assert got == {
        1: "no scenes were written", 2: "missing a hook (the first line)", 3: 'uses an off-brand / non-compliant phrase: "never say"', 4: "states a real number but no proof scene is marked",
        5: "script too short (~1s of spoken content)", 6: "script too long (~120s spoken)", 7: None,
    }


def test_one_tick(spark):
    config = spark.createDataFrame([("en", 3, "semi", False, [], [], False, []), ("fr", 3, None, False, [], [], False, [])], BRAND_SCHEMA)
    rows = [
        ticket(1, "outlier", "fr"), ticket(2, "outlier"), ticket(3, "staged"), ticket(4, "staged", gate="awaiting_footage"), ticket(5, "staged", gate="awaiting_footage"), ticket(6, "sourced", failure="broke", tries=1),
        ticket(7, "sourced", failure="broke", tries=2), ticket(8, "ready"), ticket(9, "posted"), ticket(10, "ready", gate="parked"), ticket(11, "ready", autopilot=False), ticket(12, "staged", capture_mode="repurpose"),
    ]
    b = beats(spark, [(k, "a", "", "c" if k == 5 else "", None, False) for k in (3, 4, 5, 12)])
    got = {r.id: (r.outcome, r.stage_after, r.gate_after, r.tries_after) for r in lifecycle.tick_outcome(spark.createDataFrame(rows, TICKET), b, config).collect()}
    assert got == {
        1: ("gated", "scripted", "awaiting_approval", 0), 2: ("advanced", "scripted", None, 0), 3: ("footage", "staged", "awaiting_footage", 0), 4: ("waiting", "staged", "awaiting_footage", 0), 5: ("advanced", "sourced", None, 0),
        6: ("retry", "sourced", None, 2), 7: ("parked", "sourced", "parked", 3), 8: ("gated", "scheduled", "awaiting_approval", 0), 9: ("done", "posted", "done", 0), 10: ("waiting", "ready", "parked", 0), 12: ("advanced", "sourced", None, 0),
    }


def test_post_gate_and_caption(spark):
    entry = lambda **kw: tuple(kw.get(c, "") for c in COPY)
    schema = f"id long, hook_text string, angle string, platforms array<string>, captions map<string,string>, post_meta map<string,struct<{','.join(c + ':string' for c in COPY)}>>"
    rows = [(1, "h", "a", [], None, None), (2, "h", "a", ["tt", "yt"], None, {"tt": entry(caption="c", hashtags="#x")}), (3, "", "a", ["yt"], None, {"yt": entry(title="t")}), (4, "", "a", ["ig"], {"yt": "old"}, {"ig": entry(caption=" ")})]
    t = spark.createDataFrame(rows, schema)
    assert [r.reason for r in lifecycle.post_gate(t).orderBy("id").collect()] == ["no target platforms are set", "missing post copy for yt", None, "missing post copy for ig"]
    assert [r.caption for r in lifecycle.publish_caption(t).orderBy("id").collect()] == ["h", "c #x", "t", "old"]
    once = lifecycle.migrated_captions(t)
    assert [r.post_meta for r in lifecycle.migrated_captions(once).orderBy("id").collect()] == [r.post_meta for r in once.orderBy("id").collect()]


def test_hook_among_filler(spark):
    filler = " ".join(["the weather was mild and the road went on for a while longer."] * 12)
    hook = "Why do most people never get rich? " + " ".join(["You lose money because you never count it."] * 6)
    w = words(spark, {1: f"{filler} {hook} {filler}", 2: "a few words only."})
    got = {}
    for r in transcript.find_moments(w).collect():
        got.setdefault(r.project_id, []).append(r)
    start = len(filler.split()) * 0.4 + 12 * 0.3
    best = max(got[1], key=lambda r: r.score)
    assert abs(best.start - start) < 2 and best.hook.startswith("Why do most people") and "question" in best.reason and best.title == "Why Do Most People Never Get"
    assert len(got[1]) <= 6 and all(14.5 <= r.end - r.start <= 60.5 for r in got[1])
    assert got.get(2) is None  # under three seconds
    silent = transcript.without_speech(spark.createDataFrame([(1,), (3,)], "id long"), w).collect()
    assert [(r.id, r.error) for r in silent] == [(3, transcript.NO_SPEECH)]


def test_fillers_and_chunks(spark):
    w = words(spark, {1: "Um, like this uh umbrella hmm"})
    assert sorted((r.a, r.b) for r in transcript.filler_cuts(w, 0).collect()) == [(0, 400), (1200, 1600), (2000, 2400)]
    long_ = spark.range(2001).select(F.lit(1).cast("long").alias("project_id"), F.col("id").alias("idx"), F.lit("w").alias("word"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 500).alias("end_ms"))
    assert sorted((r.chunk_start, r.n) for r in transcript.chunks(long_).collect()) == [(0, 1200), (1_140_000, 861)]


def test_boundaries(spark):
    w = words(spark, {1: " ".join(["one two three four."] * 40)})  # sentences of 1.6 s, 0.3 s apart
    clips = spark.createDataFrame([(1, 5_000, 24_000, "a"), (1, 10_000, 12_000, "short"), (1, 0, 75_900, "long"), (1, 9, 9, "none")], "project_id long, start_ms long, end_ms long, name string")
    got = {r.name: (r.start_ms, r.end_ms) for r in transcript.normalised(clips, w).collect()}
    assert set(got) == {"a", "short", "long"}
    starts, ends = {k * 1900 for k in range(40)}, {k * 1900 + 1600 for k in range(40)}
    assert all(a in starts and b in ends for a, b in got.values())
    assert got["a"] == (5700, 24400) and 13_000 <= got["short"][1] - got["short"][0] <= 17_000 and got["long"][1] - got["long"][0] <= 62_000


def test_titles(spark):
    df = spark.createDataFrame([("the NASA's (end) of don't, été and more words",), ("... !",)], "t string")
    assert [r[0] for r in df.select(transcript.title_of(F.col("t"))).collect()] == ["The NASA's End of Don't Été", "Untitled moment"]


def test_layout_of_captions(spark):
    no = F.lit(False)

    def fit(*texts, emphasis=(), emoji=""):
        ws = F.array(*[layout.word_em(F.lit(t.upper()), F.lit(k in emphasis), F.lit(emoji if k in emphasis else "")) for k, t in enumerate(texts)])
        r = spark.range(1).select(layout.fit_layout(ws).alias("f")).first().f
        return int(126 * r.scale), r.split

    assert fit("the", "cat") == (126, None)
    assert fit("gratification", "monkey") == (102, 1)
    assert fit("gratification", "monkey", emphasis=(1,), emoji="🐒") == (102, 1)
    assert fit("procrastinator") == (85, None)
    assert fit("x" * 34) == (56, None)
    wrap = lambda t, n: spark.range(1).select(layout.wrapped(F.lit(t), n)).first()[0]
    assert wrap("a\nb", 11) == ["a", "b"] and wrap(" \n ", 11) == [] and wrap("\none two three\n\nfour\n", 8) == ["one two", "three", "", "four"]
    assert spark.range(1).select(layout.word_em(F.lit("MONKEY"), no, F.lit(""))).first()[0] == 4389 * 112 / 100


def test_scripts(spark):
    texts = {
        1: "one\ntwo\nthree", 2: "one\ntwo\n\nthree", 3: "Spoken: hi\nShot: a desk\nOn-screen: big", 4: "HOOK: wow\nBEAT 1\nfirst\nBEAT 2: second has 3\nProof: no\n---\n\n# Third\nVO: said\nplain",
        5: "1. one\n2) two", 6: "", 7: "beats me", 8: "Beat.\nx",
    }
    t = spark.createDataFrame(list(texts.items()), "ticket_id long, text string")
    got = {}
    for r in scripts.parsed(t).orderBy("ticket_id", "order_index").collect():
        got.setdefault(r.ticket_id, []).append((r.spoken_line, r.on_screen_text, r.shot_cue, r.is_proof_beat))
    plain = lambda *xs: [(x, "", "", False) for x in xs]
    assert got == {
        1: plain("one", "two", "three"), 2: plain("one two", "three"), 3: [("hi", "big", "a desk", False)], 4: plain("first", "second has 3", "Third", "") [:2] + plain("said Third plain"),
        5: plain("one", "two"), 7: plain("beats me"), 8: plain("x"),
    }
    assert [(r.ticket_id, r.hook) for r in scripts.hooks(t).collect()] == [(4, "wow")]


def test_alignment(spark):
    rows = [(1, ["a", "b", "c"], ["a", "c"], [0.0, 2.0], 3.0), (2, ["a", "b"], ["x"], [0.5], 1.0), (3, ["It's", "OK"], ["its", "ok."], [0.2, 5.0], 2.0)]
    got = {}
    for r in matching.aligned(spark.createDataFrame(rows, "id long, known array<string>, heard array<string>, starts array<double>, duration double")).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    assert got == {1: [(0, 1), (1, 2), (2, 3)], 2: [(0, 0.5), (0.5, 1)], 3: [(0.2, 2), (2, 2)]}


def test_shots(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    hist = [a] * 4 + [b] + [a] * 6 + [b] * 2  # frames 250 ms apart: changes at 1000, 1250 and 2750 ms, the end at 3000
    f = spark.createDataFrame([(1, k, h) for k, h in enumerate(hist)], "track_id long, frame long, hist array<double>")
    assert sorted(r.start_ms for r in matching.shot_cuts(f).collect()) == [0, 1000]
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1000, 0.52), (1, 2000, None), (1, 3000, 0.9)], "track_id long, start_ms long, center double")
    assert sorted((r.start_ms, r.center) for r in matching.folded_shots(s).collect()) == [(0, 0.5), (3000, 0.9)]


def test_match_score(spark):
    takes = spark.createDataFrame([(1, "stop eating sugar for breakfast today")], "take_id long, text string")
    lines = spark.createDataFrame([(1, "Stop eating sugar for breakfast.")], "line_id long, text string")
    assert round(matching.match_scores(takes, lines).first().score, 3) == 0.909
    assert [r[0] for r in spark.createDataFrame([("One. Two",), ("no end",), ("a.b c! d",)], "t string").select(matching.first_sentence(F.col("t"))).collect()] == ["One.", "no end", "a.b c!"]
