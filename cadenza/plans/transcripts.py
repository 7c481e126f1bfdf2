"""Queries over timed transcripts and ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators import transcript as t
from cadenza.plans.ctes import with_ctes
from cadenza.sources import bridge as b
from cadenza.storage import stored


def spans(words):
    """Each project's whole time."""
    return words.groupBy("project_id").agg(F.lit(0).cast("long").alias("lo"), F.max("end_ms").alias("hi"))


def segments(s, d):
    return t.kept_segments(b.words(s, d))


def pieces(s, d):
    """Words cut before each hyphen."""
    bits = F.filter(F.split(F.replace("word", F.lit("-"), F.lit("\x01-")), "\x01"), lambda x: x != "")
    whole = ~F.contains("word", F.lit("-")) & ~F.contains("word", F.lit("\x01"))
    w = b.words(s, d).withColumn("bits", F.when(whole, F.array("word")).otherwise(bits))
    p = w.select("project_id", "idx", "start_ms", "end_ms", F.posexplode("bits").alias("k", "word"))
    return p.select("project_id", (F.col("idx") * 1000 + F.col("k")).alias("idx"), "word", "start_ms", "end_ms")


def clip_windows(s, d):
    """Windows of 15 s over the whole of each project, each 10 s after the one before."""
    starts = F.explode(F.sequence("lo", "hi", F.lit(10_000).cast("long")))
    return spans(b.words(s, d)).select("project_id", starts.alias("a")).withColumn("b", F.col("a") + 15_000)


def words_in_clip(s, d):
    return iv.words_in(b.words(s, d), clip_windows(s, d)).select("project_id", F.col("a").alias("clip"), "idx", (F.col("start_ms") - F.col("a")).alias("rel_ms"))


def sents(s, d):
    return t.sentences(b.words(s, d))


def scored(s, d):
    x = stored(sents(s, d), "sentences")
    return t.features(x, t.candidates(x))


def ticks(s, d):
    """A point each 5 s of each project."""
    return spans(b.words(s, d)).select("project_id", F.explode(F.sequence("lo", "hi", F.lit(5000).cast("long"))).alias("t"))


def steps(s, d):
    """A crop step at every sentence."""
    return sents(s, d).select("project_id", F.col("start_ms").alias("start"), ((F.col("sid") % 7) / 10.0).alias("value"))


def scene_markers(s, d, beats=b.beats):
    """Scenes of a ticket's beats on one timeline: 400 ms a word, 0.8 s at least, 3 s without words."""
    n = F.size(F.filter(F.split("spoken_line", "[ \t\r\n]+"), lambda x: x != ""))
    x = beats(s, d).withColumn("ms", F.when(n == 0, 3000).otherwise(F.greatest(n * 400, F.lit(800))).cast("long"))
    w = Window.partitionBy("ticket_id").orderBy("order_index")
    start = F.coalesce(F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("ticket_id", "order_index", start.alias("start_ms"), (start + F.col("ms")).alias("end_ms"), F.substring("spoken_line", 1, 40).alias("label"))


def clamp_markers(s, d):
    """Scenes inside the trim [2 s, 12 s), rebased; those of 0.2 s or less go."""
    m = scene_markers(s, d)
    a, z = F.greatest("start_ms", F.lit(2000)), F.least("end_ms", F.lit(12000))
    return m.where(z - a > 200).select("ticket_id", "order_index", (a - 2000).alias("start_ms"), (z - 2000).alias("end_ms"))


def title_spans(s, d):
    """A title shown from 2 s to 6 s, cut to each scene and rebased; 50 ms or less goes."""
    m = scene_markers(s, d, b.all_beats)
    a, z = F.greatest("start_ms", F.lit(2000)), F.least("end_ms", F.lit(6000))
    return m.where(z - a > 50).select("ticket_id", "order_index", (a - F.col("start_ms")).alias("at_ms"), (z - a).alias("for_ms"))


def even_split(s, d):
    """Each beat's words spread evenly over ten seconds."""
    toks = F.filter(F.split("spoken_line", "[ \t\r\n]+"), lambda x: x != "")
    x = b.all_beats(s, d).select("id", F.posexplode(toks).alias("k", "word"), F.size(toks).alias("n"))
    return x.select("id", F.col("k").cast("long").alias("k"), "word", F.floor(F.col("k") * 10000 / F.col("n")).alias("start_ms"), F.floor((F.col("k") + 1) * 10000 / F.col("n")).alias("end_ms"))


def track_mean(s, d):
    """Duration-weighted mean of each project's crop steps, to four places."""
    hi = spans(b.words(s, d))
    x = steps(s, d).join(hi, "project_id").withColumn("until", F.coalesce(F.lead("start").over(Window.partitionBy("project_id").orderBy("start")), F.col("hi")))
    ms = F.col("until") - F.col("start")
    return x.groupBy("project_id").agg(F.bround(F.sum(F.round(F.col("value") * 10).cast("long") * ms) / F.greatest(F.sum(ms), F.lit(1)) / 10.0, 4).alias("center"))


def shot_center(s, d):
    return steps(s, d).groupBy("project_id").agg(F.median("value").alias("center"))


def track_remap(s, d):
    """Crop steps' starts on the edited timeline, of projects with two at least."""
    st = steps(s, d).select("project_id", F.col("start").alias("t"), F.count("*").over(Window.partitionBy("project_id")).alias("n"))
    return iv.remapped_points(st.where("n >= 2"), segments(s, d))


def caption_at(s, d):
    """The caption line on screen at each tick, with a tail of 150 ms, and its active word: the last that has begun."""
    # words begin in order, so the line of the last word to have begun is the last line to have begun
    line = Window.partitionBy("project_id", "seg", "part")
    w = t.lined(b.words(s, d)).select("project_id", "idx", "word", "start_ms", "end_ms", F.max("end_ms").over(line).alias("line_end"))
    shown = iv.begun_at_ticks(w, 5000).where("t <= line_end + 150")
    return shown.select("project_id", "t", F.col("idx").alias("active_idx"), "word")


def normalised(s, d):
    """Scored candidates at their boundaries."""
    return t.normalised_candidates(b.words(s, d))


def silent(s, d):
    docs = b.table(s, d, "documents").select(F.col("doc_id").alias("id"))
    return t.without_speech(docs, b.words(s, d))


QUERIES = {
    "merge_word_pieces": lambda s, d: t.merge_pieces(pieces(s, d)),
    "sentences": sents,
    "pause_ranges": lambda s, d: iv.merged(t.pause_cuts(b.words(s, d))),
    "filler_ranges": lambda s, d: iv.merged(t.filler_cuts(b.words(s, d))),
    "range_union": lambda s, d: iv.merged(b.cuts(s, d)),
    "range_subtract": lambda s, d: iv.subtract(iv.merged(t.pause_cuts(b.words(s, d))), t.filler_cuts(b.words(s, d), 400)),
    "range_new": lambda s, d: iv.uncovered(t.pause_cuts(b.words(s, d)), iv.merged(t.filler_cuts(b.words(s, d), 400))),
    "kept_segments": segments,
    "remap_words": lambda s, d: iv.remapped(b.words(s, d), segments(s, d)),
    "remap_keyframes": lambda s, d: iv.remapped_points(ticks(s, d), segments(s, d)),
    "words_in_clip": words_in_clip,
    "asof_center": lambda s, d: iv.as_of(ticks(s, d), steps(s, d), "project_id"),
    "snap_boundary": lambda s, d: iv.snapped(ticks(s, d), sents(s, d).select("project_id", F.col("start_ms").alias("edge")), "project_id"),
    "track_mean": track_mean,
    "shot_center": shot_center,
    "track_remap": track_remap,
    "scene_markers": scene_markers,
    "clamp_markers": clamp_markers,
    "title_spans": title_spans,
    "even_split": even_split,
    "moment_candidates": lambda s, d: t.candidates(sents(s, d)),
    "moment_features": scored,
    "moment_titles": lambda s, d: t.titles(sents(s, d)),
    "normalise_moments": normalised,
    "silent_projects": silent,
    "cut_seconds": lambda s, d: iv.total_ms(b.cuts(s, d)),
    "annotate_words": lambda s, d: iv.inside_cuts(b.words(s, d), b.cuts(s, d)),
    "pick_moments": lambda s, d: t.pick_moments(scored(s, d)),
    "dedupe_moments": lambda s, d: t.dedupe_moments(scored(s, d)),
    "find_moments": lambda s, d: t.find_moments(b.words(s, d)),
    "transcript_chunks": lambda s, d: t.chunks(b.words(s, d)),
    "stamped_transcript": lambda s, d: t.stamped(b.words(s, d)),
    "caption_lines": lambda s, d: t.caption_lines(b.words(s, d)),
    "caption_events": lambda s, d: t.caption_events(b.words(s, d)),
    "caption_at": caption_at,
}


def merge_sql(source: str, out: str, touch: int = 1) -> str:
    """CTE `out`: source's ranges merged per project."""
    return f""", {out}_m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY project_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {touch} THEN 1 ELSE 0 END AS g FROM {source} WHERE b > a),
{out}_i AS (SELECT project_id, a, b, sum(g) OVER (PARTITION BY project_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_m),
{out} AS (SELECT project_id, min(a) AS a, max(b) AS b FROM {out}_i GROUP BY project_id, isl)
"""


SPANS = ", spans AS (SELECT project_id, 0::BIGINT AS lo, max(end_ms) AS hi FROM words GROUP BY 1)\n"
KEPT = (
    SPANS
    + ", clamped AS (SELECT project_id, greatest(a, lo) AS a, least(b, hi) AS b FROM cuts JOIN spans USING (project_id))\n"
    + merge_sql("clamped", "isle", 0)
    + """, bounds AS (SELECT project_id, a, b FROM isle UNION ALL SELECT project_id, hi, hi FROM spans),
segs AS (SELECT project_id, coalesce(lag(b) OVER p, 0) AS a, a AS b FROM bounds WINDOW p AS (PARTITION BY project_id ORDER BY a, b)),
kept AS (SELECT project_id, a, b, coalesce(sum(b - a) OVER (PARTITION BY project_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM segs WHERE b > a)
"""
)
TICKS = ", ticks AS (SELECT project_id, unnest(range(0, hi + 1, 5000)) AS t FROM spans)\n"
STEPS = ", steps AS (SELECT project_id, start_ms AS start, (sid % 7) / 10.0::DOUBLE AS value FROM sents)\n"
POINTS = "SELECT project_id, t, arg_min(base + greatest(t - a, 0), a) AS new_t FROM {} JOIN kept USING (project_id) WHERE t >= a - 1 AND t < b + 1 GROUP BY 1, 2"
BEAT_WORDS = "list_filter(regexp_split_to_array(spoken_line, '[ \\t\\r\\n]+'), lambda x: x <> '')"
SCENES = f", timed AS (SELECT *, CASE WHEN len({BEAT_WORDS}) = 0 THEN 3000 ELSE greatest(len({BEAT_WORDS}) * 400, 800) END AS ms FROM beats), scenes AS (SELECT ticket_id, order_index, sum(ms) OVER w - ms AS start_ms, sum(ms) OVER w AS end_ms, substr(spoken_line, 1, 40) AS label FROM timed WINDOW w AS (PARTITION BY ticket_id ORDER BY order_index))\n"
CANDS = """, pairs AS (SELECT x.project_id, x.sid AS i, y.sid AS j, x.start_ms, y.end_ms, y.end_ms - x.start_ms AS ms FROM sents x JOIN sents y ON y.project_id = x.project_id AND y.sid >= x.sid AND y.end_ms - x.start_ms BETWEEN 15000 AND 60000),
best AS (SELECT project_id, i, j, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY project_id, i ORDER BY abs(ms - 30000), j) AS r1, row_number() OVER (PARTITION BY project_id, i ORDER BY abs(ms - 50000), j) AS r2 FROM pairs) WHERE r1 = 1 OR r2 = 1),
cands AS (SELECT * FROM best UNION ALL SELECT project_id, 0, max(sid), min(start_ms), max(end_ms) FROM sents WHERE project_id NOT IN (SELECT project_id FROM best) GROUP BY 1)
"""
LEX = {k: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + ")" for k, v in (("emo", t.EMOTION), ("you", t.SECOND), ("contrast", t.CONTRAST), ("small", t.SMALL_WORDS))}
QUOTED = {k: v.replace("'", "''") for k, v in (("opens", t.OPENS), ("number", t.NUMBER), ("marks", t.MARKS))}
COUNT = lambda k: f"len(list_filter(toks, lambda x: x IN {LEX[k]}))"
SIGNS = ["asks", "opens", "fnum > 0", "femo > 0", "emo >= 2 AND femo = 0", "num > 0 AND fnum = 0", "you * 100 > tot * 3", "rhythm >= 0.9", "punch >= 0.5 AND j > i"]
SCORED = (
    CANDS
    + f""", tk AS (SELECT *, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(lower(x), '[^a-z0-9'']', '', 'g')), lambda x: x <> '') AS toks FROM sents),
sc AS (SELECT *, {COUNT("emo")} AS emo, {COUNT("you")} AS you, {COUNT("contrast")} AS con, regexp_matches(text, '{QUOTED["number"]}')::INT AS num, (n <= 12)::INT AS short, len(toks) AS tn, regexp_matches(text, '[.!?]$') AS ends, ends_with(text, '?') AS asks, regexp_matches(text, '{QUOTED["opens"]}') AS opens FROM tk),
hk AS (SELECT *, least(100, 45 * asks::INT + 35 * opens::INT + 15 * num + 20 * (emo > 0)::INT + 10 * (you > 0)::INT) / 100.0::DOUBLE AS hook, max(end_ms) OVER (PARTITION BY project_id) AS last_ms, min(start_ms) OVER (PARTITION BY project_id) AS first_ms FROM sc),
su AS (SELECT c.project_id, c.i, c.j, c.start_ms, c.end_ms, sum(s.emo) AS emo, sum(s.you) AS you, sum(s.con) AS con, sum(s.num) AS num, sum(s.short) AS short, sum(s.tn) AS tn FROM cands c JOIN sc s ON s.project_id = c.project_id AND s.sid BETWEEN c.i AND c.j GROUP BY ALL),
fe AS (SELECT su.*, f.hook, f.asks, f.opens, f.num AS fnum, f.emo AS femo, f.last_ms, f.first_ms, l.ends, greatest(su.tn, 1) AS tot, greatest(su.tn, 1) * 1000.0::DOUBLE / greatest(su.end_ms - su.start_ms, 100) AS wps, greatest(f.last_ms - f.first_ms, 1000) AS span FROM su JOIN hk f ON f.project_id = su.project_id AND f.sid = i JOIN hk l ON l.project_id = su.project_id AND l.sid = j),
fb AS (SELECT *, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, 25.0::DOUBLE * emo / tot) + CASE WHEN num > 0 AND fnum = 0 THEN 0.2 ELSE 0 END::DOUBLE) + CASE WHEN con > 0 THEN 0.1 ELSE 0 END::DOUBLE) + CASE WHEN you * 100 > tot * 3 THEN 0.15 ELSE 0 END::DOUBLE) AS body,
  CASE WHEN wps BETWEEN 2.0 AND 3.6 THEN 1.0 ELSE greatest(0.0, 1 - abs(wps - 2.8) / 2.8) END::DOUBLE AS rhythm, short / (j - i + 1)::DOUBLE AS punch, CASE WHEN ends THEN 1.0 ELSE 0.6 END::DOUBLE AS complete FROM fe),
fs AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {x} THEN '{v}' END" for x, v in zip(SIGNS, t.SIGNALS, strict=True))}], lambda x: x IS NOT NULL)[1:4] AS signs FROM fb),
scored AS (SELECT project_id, i, j, start_ms, end_ms, hook, body, rhythm, punch, complete, greatest(0.0, least(1.0, 0.4::DOUBLE * hook + 0.25::DOUBLE * body + 0.15::DOUBLE * rhythm + 0.1::DOUBLE * punch + 0.1::DOUBLE * complete - CASE WHEN (start_ms - first_ms) * 100 < span * 3 THEN 0.15 WHEN (end_ms - first_ms) * 100 > span * 97 THEN 0.08 ELSE 0 END::DOUBLE))::DOUBLE AS quality,
  CASE WHEN end_ms - start_ms NOT BETWEEN 15000 AND 60000 THEN 'Built-in finder: the whole video (shorter than one clip).' WHEN len(signs) > 0 THEN 'Built-in finder: ' || array_to_string(signs, ', ') || '.' ELSE 'Built-in finder: a complete thought at a natural pace.' END AS reason FROM fs)
"""
)
OVERLAP = "greatest(0, least(x[1].e, k.e) - greatest(x[1].s, k.s))"
GREEDY = """, sorted AS (SELECT project_id, list([{{'s': start_ms, 'e': end_ms, 'i': i, 'j': j, 'q': quality}}] ORDER BY quality DESC, start_ms, end_ms) AS l FROM scored GROUP BY 1),
folded AS (SELECT project_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) >= {most} OR len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM sorted)
SELECT f.project_id, m.i AS i, m.j AS j, m.s AS start_ms, m.e AS end_ms, hook, body, rhythm, punch, complete, quality, reason FROM folded f JOIN scored c ON c.project_id = f.project_id AND c.i = m.i AND c.j = m.j"""
# the four lookups of a clip's boundaries, each a correlated minimum
EDGE = lambda at, side: f"coalesce(nullif((SELECT arg_min(e.{side}_sent, (abs(e.{side}_sent - {at}), e.{side}_sent)) FROM edges e WHERE e.project_id = c.project_id AND abs(e.{side}_sent - {at}) < 3000), 0), (SELECT arg_min(e.{side}_word, (abs(e.{side}_word - {at}), e.{side}_word)) FROM edges e WHERE e.project_id = c.project_id))"
NORMAL = (
    SCORED
    + f""", edges AS (SELECT project_id, start_ms AS s_word, end_ms AS e_word, CASE WHEN lag(regexp_matches(word, '[.!?]$')) OVER (PARTITION BY project_id ORDER BY idx) THEN start_ms END AS s_sent, CASE WHEN regexp_matches(word, '[.!?]$') THEN end_ms END AS e_sent FROM words),
vid AS (SELECT project_id, min(start_ms) AS v0, max(end_ms) AS v1 FROM words GROUP BY 1),
n1 AS (SELECT c.*, v0, v1, greatest(v0, {EDGE("c.start_ms", "s")}) AS x, least(v1, {EDGE("c.end_ms", "e")}) AS y FROM scored c JOIN vid USING (project_id)),
n2 AS (SELECT c.* REPLACE (CASE WHEN y - x < 15000 THEN {EDGE("least(c.v1, c.x + 15000)", "e")} ELSE y END AS y) FROM n1 c),
n3 AS (SELECT c.* REPLACE (least(v1, CASE WHEN y - x > 60000 THEN {EDGE("(c.x + 60000)", "e")} ELSE y END) AS y) FROM n2 c)
SELECT project_id, x AS start_ms, y AS end_ms, quality, i, j FROM n3 WHERE y - x >= 3000"""
)
LINES = ", sg AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM words), pt AS (SELECT *, (row_number() OVER (PARTITION BY project_id, seg ORDER BY idx) - 1) // 4 AS part FROM sg)\n"
ORACLES = {
    "merge_word_pieces": with_ctes("words", ", bits AS (SELECT project_id, idx, start_ms, end_ms, list_filter(string_split(replace(word, '-', chr(1) || '-'), chr(1)), lambda x: x <> '') AS l FROM words), pcs AS (SELECT project_id, idx * 1000 + generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS word, start_ms, end_ms FROM bits), g AS (SELECT *, sum(CASE WHEN NOT starts_with(word, '-') OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY idx) AS g FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY idx) AS rn FROM pcs)) SELECT project_id, min(idx) AS idx, string_agg(word, '' ORDER BY idx) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY project_id, g"),
    "sentences": with_ctes("sents", "SELECT * FROM sents"),
    "pause_ranges": with_ctes("cuts", merge_sql("pauses", "m") + "SELECT * FROM m"),
    "filler_ranges": with_ctes("cuts", merge_sql("fillers", "m") + "SELECT * FROM m"),
    "range_union": with_ctes("cuts", merge_sql("cuts", "m") + "SELECT * FROM m"),
    "range_subtract": with_ctes("cuts", ", wide AS (SELECT project_id, greatest(start_ms - 400, 0) AS a, least(end_ms + 400, last_ms) AS b FROM spans_of_fillers)" + merge_sql("wide", "w") + merge_sql("pauses", "p") + ", ov AS (SELECT p.project_id, p.a, p.b, w.a AS ca, w.b AS cb FROM p LEFT JOIN w ON w.project_id = p.project_id AND w.a < p.b AND w.b > p.a), ed AS (SELECT *, coalesce(lag(cb) OVER q, a) AS x, coalesce(ca, b) AS y, lead(ca) OVER q IS NULL AS lst FROM ov WINDOW q AS (PARTITION BY project_id, a, b ORDER BY ca)), r AS (SELECT project_id, x AS a, y AS b FROM ed UNION ALL SELECT project_id, cb, b FROM ed WHERE lst) SELECT * FROM r WHERE b > a"),
    "range_new": with_ctes("cuts", ", wide AS (SELECT project_id, greatest(start_ms - 400, 0) AS a, least(end_ms + 400, last_ms) AS b FROM spans_of_fillers)" + merge_sql("wide", "w") + "SELECT * FROM pauses p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.project_id = p.project_id AND w.a <= p.a + 1 AND w.b >= p.b - 1)"),
    "kept_segments": with_ctes("cuts", KEPT + "SELECT * FROM kept"),
    "remap_words": with_ctes("cuts", KEPT + "SELECT project_id, idx, s AS new_start, CASE WHEN e > s THEN e ELSE s + 150 END AS new_end FROM (SELECT project_id, idx, min(base + least(greatest(start_ms, a), b) - a) AS s, max(base + least(greatest(end_ms, a), b) - a) AS e FROM words JOIN kept USING (project_id) WHERE end_ms > a AND start_ms < b GROUP BY 1, 2)"),
    "remap_keyframes": with_ctes("cuts", KEPT + TICKS + POINTS.format("ticks")),
    "words_in_clip": with_ctes("words", SPANS + ", cl AS (SELECT project_id, unnest(range(lo, hi + 1, 10000)) AS a FROM spans) SELECT w.project_id, a AS clip, idx, start_ms - a AS rel_ms FROM words w JOIN cl ON cl.project_id = w.project_id AND end_ms > a AND start_ms < a + 15000"),
    "asof_center": with_ctes("sents", SPANS + TICKS + STEPS + ", f AS (SELECT project_id, arg_min(value, start) AS v FROM steps GROUP BY 1) SELECT k.project_id, k.t, coalesce(s.value, f.v, 0.5)::DOUBLE AS center FROM ticks k ASOF LEFT JOIN steps s ON s.project_id = k.project_id AND s.start <= k.t LEFT JOIN f ON f.project_id = k.project_id"),
    "snap_boundary": with_ctes("sents", SPANS + TICKS + ", n AS (SELECT k.project_id, k.t, s.start_ms, row_number() OVER (PARTITION BY k.project_id, k.t ORDER BY abs(s.start_ms - k.t), s.start_ms) AS r FROM ticks k LEFT JOIN sents s ON s.project_id = k.project_id AND abs(s.start_ms - k.t) < 3000) SELECT project_id, t, coalesce(start_ms, t) AS snapped FROM n WHERE r = 1"),
    "track_mean": with_ctes("sents", SPANS + STEPS + ", u AS (SELECT project_id, round(value * 10)::BIGINT AS v, coalesce(lead(start) OVER (PARTITION BY project_id ORDER BY start), hi) - start AS ms FROM steps JOIN spans USING (project_id)) SELECT project_id, round_even(sum(v * ms)::DOUBLE / greatest(sum(ms), 1) / 10.0::DOUBLE, 4)::DOUBLE AS center FROM u GROUP BY 1"),
    "shot_center": with_ctes("sents", STEPS + "SELECT project_id, median(value)::DOUBLE AS center FROM steps GROUP BY 1"),
    "track_remap": with_ctes("sents cuts", KEPT + STEPS + ", pts AS (SELECT project_id, start AS t FROM steps WHERE project_id IN (SELECT project_id FROM steps GROUP BY 1 HAVING count(*) >= 2)) " + POINTS.format("pts")),
    "scene_markers": with_ctes("beats", SCENES + "SELECT ticket_id, order_index, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, label FROM scenes"),
    "clamp_markers": with_ctes("beats", SCENES + "SELECT ticket_id, order_index, (greatest(start_ms, 2000) - 2000)::BIGINT AS start_ms, (least(end_ms, 12000) - 2000)::BIGINT AS end_ms FROM scenes WHERE least(end_ms, 12000) - greatest(start_ms, 2000) > 200"),
    "title_spans": with_ctes("all_beats", SCENES + "SELECT ticket_id, order_index, (greatest(start_ms, 2000) - start_ms)::BIGINT AS at_ms, (least(end_ms, 6000) - greatest(start_ms, 2000))::BIGINT AS for_ms FROM scenes WHERE least(end_ms, 6000) - greatest(start_ms, 2000) > 50"),
    "even_split": with_ctes("all_beats", f", l AS (SELECT id, {BEAT_WORDS} AS ws FROM beats), k AS (SELECT id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM l) SELECT id, k, word, floor(k * 10000 / n::DOUBLE)::BIGINT AS start_ms, floor((k + 1) * 10000 / n::DOUBLE)::BIGINT AS end_ms FROM k"),
    "moment_candidates": with_ctes("sents", CANDS + "SELECT * FROM cands"),
    "moment_features": with_ctes("sents", SCORED + "SELECT * FROM scored"),
    "pick_moments": with_ctes("sents", SCORED + GREEDY.format(most=6, clash=f"{OVERLAP} * 4 > x[1].e - x[1].s")),
    "dedupe_moments": with_ctes("sents", SCORED + GREEDY.format(most=1000000, clash=f"least(x[1].e - x[1].s, k.e - k.s) > 0 AND {OVERLAP} * 2 > least(x[1].e - x[1].s, k.e - k.s)")),
    "normalise_moments": with_ctes("sents", NORMAL),
    "silent_projects": with_ctes("words", f"SELECT doc_id AS id, '{t.NO_SPEECH}' AS error FROM documents WHERE doc_id NOT IN (SELECT project_id FROM words)"),
    "cut_seconds": with_ctes("cuts", merge_sql("cuts", "m") + "SELECT project_id, sum(b - a)::BIGINT AS total_ms FROM m GROUP BY 1"),
    "annotate_words": with_ctes("cuts", "SELECT project_id, idx, EXISTS (SELECT 1 FROM cuts c WHERE c.project_id = w.project_id AND c.b > c.a AND c.a < w.end_ms AND c.b > w.start_ms) AS cut FROM words w"),
    "moment_titles": with_ctes("sents", f", w AS (SELECT project_id, sid, text, list_slice(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '^[{QUOTED['marks']}]+|[{QUOTED['marks']}]+$', '', 'g')), lambda x: x <> ''), 1, 6) AS ws FROM sents) SELECT project_id, sid, substr(text, 1, 200) AS hook_sentence, CASE WHEN len(ws) = 0 THEN 'Untitled moment' ELSE array_to_string(list_transform(ws, lambda x, k: CASE WHEN length(x) > 1 AND upper(x) = x AND lower(x) <> x THEN x WHEN k > 1 AND lower(x) IN {LEX['small']} THEN lower(x) ELSE CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:] END), ' ') END AS title FROM w"),
    "transcript_chunks": with_ctes("words", ", sp AS (SELECT project_id, min(start_ms) AS t0, max(end_ms) AS t1 FROM words GROUP BY 1), ch AS (SELECT project_id, t0 AS c, NULL AS e FROM sp WHERE t1 - t0 <= 1440000 UNION ALL SELECT project_id, x, x + 1200000 FROM (SELECT project_id, unnest(range(t0, t1 + 1, 1140000)) AS x FROM sp WHERE t1 - t0 > 1440000)) SELECT w.project_id, c AS chunk_start, count(*) AS n FROM words w JOIN ch ON ch.project_id = w.project_id AND start_ms >= c - 10 AND (e IS NULL OR start_ms < e) GROUP BY 1, 2"),
    "stamped_transcript": with_ctes("words", "SELECT project_id, string_agg(CASE WHEN idx % 8 = 0 THEN printf('[t=%.1f] ', start_ms / 1000.0) || word ELSE word END, ' ' ORDER BY idx) AS text FROM words GROUP BY 1"),
    "caption_lines": with_ctes("words", LINES + "SELECT project_id, min(idx) AS first_idx, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM pt GROUP BY project_id, seg, part"),
    "caption_events": with_ctes("words", LINES + "SELECT project_id, idx, min(idx) OVER (PARTITION BY project_id, seg, part) AS first_idx, start_ms, greatest(end_ms, start_ms + 50) AS event_end FROM pt"),
    "caption_at": with_ctes("words", SPANS + TICKS + LINES + ", ln AS (SELECT project_id, min(idx) AS first_idx, min(start_ms) AS ls, max(end_ms) AS le FROM pt GROUP BY project_id, seg, part), sh AS (SELECT k.project_id, k.t FROM ticks k ASOF JOIN ln ON ln.project_id = k.project_id AND ln.ls <= k.t WHERE k.t <= le + 150) SELECT h.project_id, h.t, idx AS active_idx, word FROM sh h ASOF JOIN words w ON w.project_id = h.project_id AND w.start_ms <= h.t"),
}
