"""Queries over the perf facts."""

from __future__ import annotations

from cadenza.functions.scoring import perf_score
from cadenza.operators import engagement as e
from cadenza.plans.ctes import with_ctes
from cadenza.sources import bridge as b

SCORE = "(saves * 3000 + follows * 5000 + sends * 2000 + views) / 1000.0"
SUMS = "sum(views)::BIGINT AS views, sum(follows)::BIGINT AS follows, sum(saves)::BIGINT AS saves, sum(sends)::BIGINT AS sends"
KEYED = ", keyed AS (SELECT *, coalesce(video_kind, 'reel') AS kind, coalesce(video_id, ticket_id) AS vid FROM perf WHERE coalesce(video_id, ticket_id) IS NOT NULL)\n"

QUERIES = {
    "perf_score": lambda s, d: b.perf(s, d).select("id", perf_score().alias("score")),
    "perf_latest": lambda s, d: e.latest(b.perf_log(s, d)).drop("captured_at"),
    "insights_kpis": lambda s, d: e.kpis(b.perf(s, d), b.tickets(s, d)),
    "insights_top": lambda s, d: e.top_videos(b.perf(s, d)),
    "insights_by_platform": lambda s, d: e.by_platform(b.perf(s, d)),
    "insights_trend": lambda s, d: e.trend(b.perf_log(s, d)),
    "insights_videos": lambda s, d: e.video_pivot(b.perf(s, d), e.universe(b.clips(s, d), b.tickets(s, d), b.projects(s, d))),
    "angle_rollup": lambda s, d: e.angle_rollup(b.perf(s, d), b.tickets(s, d)),
    "winning_patterns": lambda s, d: e.winning_patterns(b.perf(s, d), b.clips(s, d), b.tickets(s, d)),
    "perf_export_rows": lambda s, d: e.export_rows(b.perf(s, d)),
}
ORACLES = {
    "perf_score": with_ctes("perf", f"SELECT id, {SCORE} AS score FROM perf"),
    "perf_latest": with_ctes("perf_log", ", keyed AS (SELECT *, coalesce(video_kind, 'reel') AS kind, coalesce(video_id, ticket_id) AS vid FROM perf_log WHERE coalesce(video_id, ticket_id) IS NOT NULL) SELECT kind, vid, platform, id, views, follows, saves, sends FROM keyed QUALIFY row_number() OVER (PARTITION BY kind, vid, platform ORDER BY captured_at DESC, id DESC) = 1"),
    "insights_kpis": with_ctes("perf tickets", KEYED + f"SELECT CASE WHEN videos > 0 THEN videos ELSE (SELECT count(*) FROM tickets) END AS tickets, (SELECT count(*) FROM tickets WHERE stage = 'posted') AS posted, views, follows, saves, sends FROM (SELECT {SUMS} FROM perf), (SELECT count(DISTINCT (kind, vid)) AS videos FROM keyed)"),
    "insights_top": with_ctes("perf", KEYED + f"SELECT kind, vid, {SCORE} AS score FROM (SELECT kind, vid, min(id) AS f, {SUMS} FROM keyed GROUP BY kind, vid) ORDER BY score DESC, f LIMIT 8"),
    "insights_by_platform": with_ctes("perf", f"SELECT *, {SCORE} AS score FROM (SELECT CASE WHEN platform = '' THEN '?' ELSE platform END AS platform, {SUMS}, count(*) AS posts FROM perf GROUP BY 1)"),
    "insights_trend": with_ctes("perf_log", f"SELECT *, {SCORE} AS score FROM (SELECT coalesce(strftime(captured_at, '%Y-%m-%d'), '?') AS day, {SUMS} FROM perf_log GROUP BY 1)"),
    "insights_videos": with_ctes(
        "perf clips tickets projects",
        KEYED
        + f""", u AS (SELECT 'clip' AS kind, c.id AS vid, coalesce(markers, '') <> '' OR coalesce(p.mode, '') = 'caption' AS is_reel FROM clips c LEFT JOIN projects p ON p.id = c.project_id WHERE c.status = 'rendered' OR coalesce(markers, '') <> '' UNION ALL SELECT 'reel', id, true FROM tickets WHERE clip_url IS NOT NULL),
t AS (SELECT u.kind, u.vid, u.is_reel, {", ".join(f"coalesce(sum({c}) FILTER (platform = '{p}'), 0)::BIGINT AS {p}_{c}" for p in e.KNOWN for c in e.COUNTERS)},
  coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(follows), 0)::BIGINT AS follows, coalesce(sum(saves), 0)::BIGINT AS saves, coalesce(sum(sends), 0)::BIGINT AS sends
  FROM u LEFT JOIN keyed k ON k.kind = u.kind AND k.vid = u.vid AND platform IN ('tt', 'ig', 'yt') GROUP BY u.kind, u.vid, u.is_reel)
SELECT *, {SCORE} AS score FROM t""",
    ),
    "angle_rollup": with_ctes("perf tickets", f", r AS (SELECT ticket_id, (saves * 3000 + follows * 5000 + sends * 2000 + views) AS m FROM perf WHERE ticket_id IS NOT NULL) SELECT angle, count(DISTINCT ticket_id) AS posts_count, coalesce(round_even(sum(m)::DOUBLE / count(m) / 1000.0, 2), 0.0) AS avg_score FROM tickets LEFT JOIN r ON r.ticket_id = tickets.id GROUP BY angle"),
    "winning_patterns": with_ctes(
        "perf clips tickets",
        KEYED
        + """, f AS (SELECT kind, vid, saves + follows AS gain, id FROM keyed WHERE saves + follows > 0),
p AS (SELECT gain, f.id, 'hook' AS dimension, regexp_replace(CASE WHEN hook <> '' THEN hook ELSE title END, '^\\s+|\\s+$', '', 'g') AS value FROM f JOIN clips c ON kind = 'clip' AND vid = c.id
 UNION ALL SELECT gain, f.id, 'preset', preset FROM f JOIN clips c ON kind = 'clip' AND vid = c.id
 UNION ALL SELECT gain, f.id, 'hook', regexp_replace(hook_text, '^\\s+|\\s+$', '', 'g') FROM f JOIN tickets t ON kind = 'reel' AND vid = t.id
 UNION ALL SELECT gain, f.id, 'angle', angle FROM f JOIN tickets t ON kind = 'reel' AND vid = t.id)
SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY gain DESC, f) AS place, value, gain FROM (SELECT dimension, value, sum(gain)::BIGINT AS gain, min(id) AS f FROM p WHERE value <> '' GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY gain DESC, f) <= 5""",
    ),
    "perf_export_rows": with_ctes("perf", KEYED + f"SELECT id, kind, vid, CASE platform WHEN 'tt' THEN 'TikTok' WHEN 'ig' THEN 'Instagram' WHEN 'yt' THEN 'YouTube' ELSE platform END AS platform, strftime(captured_at, '%Y-%m-%d') AS day, views, follows, saves, sends, {SCORE} AS score FROM keyed"),
}
