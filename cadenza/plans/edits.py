"""Queries over changes, timelines' blocks, files, errors and the texts of filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import blocks, finders, lifecycle, media, tables
from cadenza.operators import intervals as iv
from cadenza.operators import transcript as t
from cadenza.plans import lifecycle as lifecycle_plans
from cadenza.plans import transcripts as tr
from cadenza.plans.ctes import with_ctes
from cadenza.sources import bridge as b


def changes(s, d):
    """A batch of folder changes: each third folder renamed, each third deleted, a folder for each brand, and tickets moved."""
    f, k = b.folders(s, d), b.tickets(s, d)
    no = F.lit(None).cast("string")
    rows = [
        f.where("id % 3 = 1").select(F.col("id").alias("seq"), F.lit("rename").alias("op"), "id", F.concat(F.lit(" "), "name", F.lit(" renamed")).alias("name")),
        f.where("id % 3 = 2").select(F.col("id").alias("seq"), F.lit("delete").alias("op"), "id", no.alias("name")),
        k.select(F.lit(0).cast("long").alias("seq"), F.lit("create").alias("op"), F.lit(None).cast("long").alias("id"), F.col("brand").alias("name")).distinct(),
        k.where("id % 24 = 0").select((F.col("id") * 2).alias("seq"), F.lit("move").alias("op"), "id", F.lit(" F1 ").alias("name")),
        k.where("id % 60 = 12").select((F.col("id") * 2 + 1).alias("seq"), F.lit("move").alias("op"), "id", F.lit("  ").alias("name")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def after_changes(s, d):
    return tables.folder_changes(b.folders(s, d), b.tickets(s, d).select("id", "folder"), changes(s, d))


def cascade(s, d):
    """What is left once the projects in error are deleted with their clips."""
    p, left = tables.without(b.projects(s, d), {"clips": (b.clips(s, d), "project_id")}, b.projects(s, d).where("status = 'error'"))
    return p.select(F.lit("project").alias("kind"), "id").unionByName(left["clips"].select(F.lit("clip").alias("kind"), "id"))


def reorder(s, d):
    """Beats after their tickets' new orders, which leave out each sixth beat and name one that isn't there."""
    beats = b.beats(s, d)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-(F.col("id") * 7 % 5)).alias("o"), "id"))), lambda x: x["id"])
    lists = beats.where("order_index % 6 <> 5").groupBy("ticket_id").agg(F.concat(listed, F.array(F.lit(-1).cast("long"))).alias("ids"))
    return tables.reordered(beats, lists).select("id", "ticket_id", "order_index")


def block_edits(s, d):
    """Each project's kept segments as blocks after five edits, split again at each 20 s."""
    seg = tr.segments(s, d)
    span = tr.spans(b.words(s, d))
    x = seg.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("x")).join(span, "project_id")
    first = F.get("x", F.lit(0))
    no = F.lit(None).cast("long")
    edit = lambda op, i=None, t=no, a=no, z=no: F.struct(F.lit(op).alias("op"), F.lit(i).cast("int").alias("i"), t.cast("long").alias("t"), a.cast("long").alias("a"), z.cast("long").alias("b"))
    middle = F.floor((first["a"] + first["b"]) / 2)
    edits = F.array(edit("split", 0, middle), edit("delete", 2), edit("trim_end", 0, first["a"] + 200), edit("trim_start", 1, F.lit(0)), edit("add", a=F.col("hi"), z=F.lit(0)))
    done = x.select("project_id", "hi", blocks.edited(F.col("x"), edits, F.col("lo"), F.col("hi")).alias("x"))
    again = done.select("project_id", blocks.with_splits(F.col("x"), F.sequence(F.lit(0).cast("long"), F.col("hi"), F.lit(20_000).cast("long"))).alias("x"))
    return again.select("project_id", F.posexplode("x").alias("k", "x")).select("project_id", "k", "x.*")


def cached_timings(s, d):
    """Cached times of words that have gone wrong: some fall, and the last lie beyond the duration."""
    w = b.words(s, d).join(tr.spans(b.words(s, d)), "project_id")
    bad = w.select("project_id", "idx", ((F.col("start_ms") - F.col("idx") % 5 * 700) / 1000.0).alias("start"), ((F.col("end_ms") - F.col("idx") % 3 * 900) / 1000.0).alias("end"), (F.floor(F.col("hi") * 9 / 10) / 1000.0).alias("duration"))
    return iv.monotone(bad, "project_id", "idx", "duration").select("project_id", "idx", "start", "end")


def scenes_left(s, d):
    """Sentences that no single cut covers, give or take 50 ms."""
    x = tr.sents(s, d).select("project_id", "sid", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    return iv.uncovered(x, iv.merged(b.cuts(s, d)), slack=50).select("project_id", "sid")


def reels(s, d):
    n = b.beats(s, d).groupBy(F.col("ticket_id").alias("id")).agg(F.count("*").alias("n_words"))
    k = b.tickets(s, d).select("id", F.col("clip_url").alias("path"), F.when(F.col("id") % 7 != 3, F.col("id") % 200 + F.col("id") % 2 * 0.5).alias("duration"))
    return k.join(n, "id", "left")


def expressions(s, d):
    return media.x_expression(tr.steps(s, d).select("project_id", F.col("start").alias("start_ms"), F.col("value").alias("center")), 1920, 608, "project_id")


def filter_texts(s, d):
    """Pads, chains, rates, sizes and preview positions of each clip."""
    i = F.col("id")
    pad = media.voice_pad(i % 50 / 10.0, i % 40 / 10.0)
    chain = media.chained(F.concat(F.lit("crop="), i), F.when(i % 3 == 0, "eq=contrast=1.1").otherwise(""), F.lit("subtitles=a"), F.when(i % 4 == 0, "zoom"), pad)
    size = media.output_size(F.lit(1080).cast("long") - i % 7, F.lit(9), F.when(i % 2 == 0, 16).otherwise(11))
    return b.clips(s, d).select("id", pad.alias("pad"), chain.alias("chain"), F.round(media.frame_rate(b.pick(b.RATES, i)), 6).alias("rate"), size["width"].alias("width"), size["height"].alias("height"), F.round(media.object_position(i % 11 / 10.0, i % 5 * 0.5), 6).alias("position"))


def careful(words):
    """A finder that only takes moments of high quality."""
    found = t.find_moments(words)
    return found.where("score >= 70")


def fallback(s, d):
    found, _ = finders.find(b.words(s, d), ["careful", "absent", "heuristic"], finders.FINDERS | {"careful": careful})
    return found.select("project_id", "start_ms", "end_ms", "score", "finder")


QUERIES = {
    "folder_table": lambda s, d: after_changes(s, d)[0],
    "folder_members": lambda s, d: after_changes(s, d)[1],
    "project_cascade": cascade,
    "reorder_beats": reorder,
    "block_edits": block_edits,
    "cached_timings": cached_timings,
    "snap_trim": lambda s, d: iv.snapped(tr.ticks(s, d), b.words(s, d).select("project_id", F.col("start_ms").alias("edge")), "project_id", 120),
    "scenes_left": scenes_left,
    "reel_gate": lambda s, d: media.reel_gate(reels(s, d), b.files(s, d)),
    "tick_with_files": lambda s, d: lifecycle.tick_outcome(b.tickets(s, d), media.lacking(b.beats(s, d), b.files(s, d)), b.brands(s, d)),
    "error_classes": lambda s, d: media.classified(b.errors(s, d), media.marker_table(s)).select("id", "class"),
    "crop_expressions": expressions,
    "filter_texts": filter_texts,
    "fallback_moments": fallback,
}
AFTER = """, kept AS (SELECT id, CASE WHEN id % 3 = 1 THEN name || ' renamed' ELSE name END AS name, name AS old_name, id % 3 = 2 AS deleted FROM folders),
fresh AS (SELECT DISTINCT brand AS name FROM tickets WHERE brand NOT IN (SELECT name FROM kept WHERE NOT deleted)),
after AS (SELECT id, name FROM kept WHERE NOT deleted UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM folders) + row_number() OVER (ORDER BY name), name FROM fresh)
"""
BLOCK = "struct_pack(a := {}, b := {})"
EDITS = f""", bl AS (SELECT project_id, hi, list({BLOCK.format("a", "b")} ORDER BY a) AS x FROM kept JOIN spans USING (project_id) GROUP BY ALL),
e0 AS (SELECT *, x[1].a AS a0, (x[1].a + x[1].b) // 2 AS m, x[1].b AS b0 FROM bl),
e1 AS (SELECT project_id, hi, a0, CASE WHEN m - a0 >= 300 AND b0 - m >= 300 THEN list_concat([{BLOCK.format("a0", "m")}, {BLOCK.format("m", "b0")}], x[2:]) ELSE x END AS x FROM e0),
e2 AS (SELECT project_id, hi, a0, CASE WHEN len(x) > 2 THEN list_concat(x[1:2], x[4:]) ELSE x END AS x FROM e1),
e3 AS (SELECT project_id, hi, list_concat([{BLOCK.format("a0", "least(coalesce(x[2].a, hi), greatest(a0 + 200, a0 + 300))")}], x[2:]) AS x FROM e2),
e4 AS (SELECT project_id, hi, CASE WHEN len(x) > 1 THEN list_concat(x[1:1], [{BLOCK.format("greatest(x[1].b, least(0, x[2].b - 300))", "x[2].b")}], x[3:]) ELSE x END AS x FROM e3),
e5 AS (SELECT *, list_reduce(list_prepend({BLOCK.format("0::BIGINT", "0::BIGINT")}, x), lambda acc, y: CASE WHEN acc.b >= y.a AND acc.b < y.b THEN y ELSE acc END).b AS first FROM e4),
e6 AS (SELECT *, coalesce(list_min(list_transform(list_filter(x, lambda y: y.a >= first AND y.a < hi), lambda y: y.a)), hi) AS upto FROM e5),
e7 AS (SELECT project_id, hi, CASE WHEN upto - first >= 300 THEN list_concat(x, [{BLOCK.format("first", "upto")}]) ELSE x END AS x FROM e6),
e8 AS (SELECT project_id, hi, unnest(x) AS y FROM e7),
e9 AS (SELECT project_id, list_sort(list_distinct(list_concat([y.a, y.b], list_filter(range(0, hi + 1, 20000), lambda m: m > y.a AND m < y.b)))) AS edges FROM e8),
e10 AS (SELECT project_id, edges[k] AS a, edges[k + 1] AS b FROM e9, unnest(range(1, len(edges))) u(k))
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY a, b) - 1 AS k, a, b FROM e10"""
FILED = b.FILES_SQL + ", fb AS (SELECT b.* REPLACE (CASE WHEN f.path IS NULL THEN '' ELSE clip_path END AS clip_path) FROM beats b LEFT JOIN (SELECT DISTINCT path FROM files) f ON f.path = b.clip_path)"
quoted = lambda x: x.replace("'", "''")
ORACLES = {
    "folder_table": with_ctes("tickets folders", AFTER + "SELECT * FROM after"),
    "folder_members": with_ctes("tickets folders", AFTER + ", tags AS (SELECT old_name AS folder, CASE WHEN NOT deleted THEN name END AS tag FROM kept WHERE deleted OR name <> old_name) SELECT t.id, CASE WHEN t.id % 60 = 12 THEN NULL WHEN t.id % 24 = 0 THEN 'F1' WHEN g.folder IS NOT NULL THEN tag ELSE t.folder END AS folder FROM tickets t LEFT JOIN tags g ON g.folder = t.folder"),
    "project_cascade": with_ctes("projects clips", "SELECT 'project' AS kind, id FROM projects WHERE status <> 'error' UNION ALL SELECT 'clip', id FROM clips WHERE project_id NOT IN (SELECT id FROM projects WHERE status = 'error') OR project_id IS NULL"),
    "reorder_beats": with_ctes("beats", ", l AS (SELECT id, row_number() OVER (PARTITION BY ticket_id ORDER BY id * 7 % 5 DESC, id) - 1 AS place FROM beats WHERE order_index % 6 <> 5) SELECT b.id, ticket_id, coalesce(place, order_index) AS order_index FROM beats b LEFT JOIN l ON l.id = b.id"),
    "block_edits": with_ctes("cuts", tr.KEPT + EDITS),
    "cached_timings": with_ctes("words", tr.SPANS + ", x AS (SELECT project_id, idx, least(greatest(0.0::DOUBLE, max((start_ms - idx % 5 * 700) / 1000.0::DOUBLE) OVER (PARTITION BY project_id ORDER BY idx)), (hi * 9 // 10) / 1000.0::DOUBLE) AS s, (end_ms - idx % 3 * 900) / 1000.0::DOUBLE AS e, (hi * 9 // 10) / 1000.0::DOUBLE AS d FROM words JOIN spans USING (project_id)) SELECT project_id, idx, round_even(s, 3)::DOUBLE AS start, round_even(least(greatest(e, s + 0.02::DOUBLE), d), 3)::DOUBLE AS \"end\" FROM x"),
    "snap_trim": with_ctes("words", tr.SPANS + tr.TICKS + ", n AS (SELECT k.project_id, k.t, w.start_ms, row_number() OVER (PARTITION BY k.project_id, k.t ORDER BY abs(w.start_ms - k.t), w.start_ms) AS r FROM ticks k LEFT JOIN words w ON w.project_id = k.project_id AND abs(w.start_ms - k.t) < 120) SELECT project_id, t, coalesce(start_ms, t) AS snapped FROM n WHERE r = 1"),
    "scenes_left": with_ctes("sents cuts", tr.merge_sql("cuts", "m") + "SELECT project_id, sid FROM sents s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project_id = s.project_id AND m.a <= s.start_ms + 50 AND m.b >= s.end_ms - 50)"),
    "reel_gate": with_ctes("tickets beats", b.FILES_SQL + f""", r AS (SELECT t.id, clip_url AS path, CASE WHEN t.id % 7 <> 3 THEN t.id % 200 + t.id % 2 * 0.5::DOUBLE END AS duration, (SELECT count(*) FROM beats b WHERE b.ticket_id = t.id) AS n FROM tickets t),
g AS (SELECT r.id, CASE WHEN coalesce(r.path, '') = '' OR f.size IS NULL THEN '{media.NO_FILE}' WHEN f.size < 10000 THEN '{media.SMALL_FILE}' WHEN duration < 3 OR duration > 180 THEN 'duration ' || round_even(duration, 0)::BIGINT || 's is outside platform bounds (3–180s)' WHEN n = 0 THEN '{media.NO_CAPTIONS}' END AS reason FROM r LEFT JOIN files f ON f.path = r.path)
SELECT id, reason, reason IS NULL AS passed FROM g"""),
    "tick_with_files": lifecycle_plans.ORACLES["tick_outcome"].replace(", lack AS (", FILED + ", lack AS (").replace("FROM beats JOIN tickets t", "FROM fb JOIN tickets t"),
    "error_classes": with_ctes("errors", "SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(message), '{quoted(m)}')''' for m in ms)} THEN '{c}'" for c, ms in media.MARKERS) + " END AS class FROM errors"),
    "crop_expressions": with_ctes("sents", tr.STEPS + ", x AS (SELECT project_id, start, lead(start) OVER (PARTITION BY project_id ORDER BY start) AS nxt, greatest(0, least(1312, round_even(value * 1920 - 304.0::DOUBLE, 0)))::BIGINT AS x FROM steps) SELECT project_id, coalesce(string_agg(printf('if(lt(t,%.3f),%d,', nxt / 1000.0::DOUBLE, x), '' ORDER BY start) FILTER (nxt IS NOT NULL), '') || max(x) FILTER (nxt IS NULL) || repeat(')', (count(*) - 1)::INT) AS expr FROM x GROUP BY 1"),
    "filter_texts": with_ctes("clips", """, p AS (SELECT id, CASE WHEN id % 50 / 10.0::DOUBLE - id % 40 / 10.0::DOUBLE > 0.05 THEN printf('tpad=stop_mode=clone:stop_duration=%.3f', id % 50 / 10.0::DOUBLE - id % 40 / 10.0::DOUBLE) ELSE '' END AS pad, 1080 - id % 7 AS w, CASE WHEN id % 2 = 0 THEN 16 ELSE 11 END AS rh, least(1.0::DOUBLE, 0.5625 / nullif(id % 5 * 0.5::DOUBLE, 0)) AS r, id % 11 / 10.0::DOUBLE AS c FROM clips)
SELECT id, pad, concat_ws(',', 'crop=' || id, CASE WHEN id % 3 = 0 THEN 'eq=contrast=1.1' END, 'subtitles=a', CASE WHEN id % 4 = 0 THEN 'zoom' END, nullif(pad, '')) AS chain, [29.97003, 25, 30, 30, 24, 30, 30][id % 7 + 1]::DOUBLE AS rate,
  w - w % 2 AS width, (round_even(w * rh / 9.0::DOUBLE, 0)::BIGINT // 2) * 2 AS height, round(CASE WHEN coalesce(r, 1) >= 1 THEN 50 ELSE greatest(0, least(1, (c - r / 2) / (1 - r))) * 100 END, 6)::DOUBLE AS position FROM p"""),
}
