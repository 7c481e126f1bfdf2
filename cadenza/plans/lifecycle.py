"""Queries over the production lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import lifecycle as l
from cadenza.plans.ctes import with_ctes
from cadenza.sources import bridge as b

CONFIG = """, config AS (SELECT * FROM (VALUES ('en', 40, 'semi', true, ['angle 0', 'angle 1', 'angle 2'], ['the', 'and'], true, ['tt', 'ig']), ('fr', 3, 'hands_off', true, ['angle 3'], []::VARCHAR[], false, []::VARCHAR[]),
  ('de', 3, 'off', false, ['angle 1'], ['tion'], true, ['yt']), ('es', 700, 'supervised', true, ['angle 4', 'angle 5'], ['que', 'es'], false, []::VARCHAR[])) t(brand, target, level, feed, angles, banned, proof_rules, cadence_platforms))
"""
STAGES = "['outlier', 'scripted', 'staged', 'sourced', 'assembled', 'ready', 'scheduled', 'posted']"
NEXT = f"CASE WHEN list_position({STAGES}, stage) BETWEEN 1 AND 7 THEN {STAGES}[list_position({STAGES}, stage) + 1] END"
BACKLOG = ", flying AS (SELECT brand, count(*) AS n FROM tickets WHERE autopilot AND stage <> 'posted' GROUP BY 1), backlog AS (SELECT c.brand, target, coalesce(n, 0) AS in_flight, greatest(target - coalesce(n, 0), 0) AS missing FROM config c LEFT JOIN flying f ON f.brand = c.brand)\n"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NAMES = f""", names AS (SELECT 'clip' AS kind, c.id, coalesce(CASE WHEN reel THEN nullif({STRIP.format("pname")}, '') ELSE nullif({STRIP.format("title")}, '') END, CASE WHEN reel THEN 'Reel ' || c.id ELSE 'Clip ' || (idx + 1) END) AS name, reel AS is_reel
  FROM (SELECT c.*, p.name AS pname, coalesce(markers, '') <> '' OR coalesce(p.mode, '') = 'caption' AS reel FROM clips c LEFT JOIN projects p ON p.id = c.project_id) c
  UNION ALL SELECT 'reel', id, coalesce(nullif({STRIP.format("coalesce(nullif(hook_text, ''), angle)")}, ''), 'Reel ' || id), true FROM tickets)
"""
OWNERS = ", f AS (SELECT project_id, min_by(brand, id) AS b FROM tickets GROUP BY 1), owners AS (SELECT 'clip' AS kind, c.id, coalesce(nullif(c.brand, ''), nullif(p.brand, ''), nullif(f.b, ''), '') AS brand FROM clips c LEFT JOIN projects p ON p.id = c.project_id LEFT JOIN f ON f.project_id = c.project_id UNION ALL SELECT 'reel', id, coalesce(brand, '') FROM tickets)\n"
COPY = f""", script AS (SELECT ticket_id, string_agg(coalesce(nullif(spoken_line, ''), nullif(caption, ''), ''), chr(10) ORDER BY order_index, id) AS script FROM beats GROUP BY 1),
lined AS (SELECT t.*, coalesce(list_filter(list_transform(regexp_split_to_array(script, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {STRIP.format("x")}), lambda x: x <> ''), []) AS ls FROM tickets t LEFT JOIN script s ON s.ticket_id = t.id),
cap AS (SELECT *, {STRIP.format("coalesce(nullif(hook_text, ''), ls[1], 'New video')")} AS new_caption, regexp_replace(lower(coalesce(brand, '')), '[^a-z0-9]', '', 'g') AS slug FROM lined),
copy AS (SELECT *, CASE WHEN slug <> '' THEN '#' || slug || ' ' ELSE '' END || '#shorts #reels #fyp' AS new_tags, substr(new_caption, 1, 70) AS new_title, coalesce(nullif(array_to_string(ls[1:2], ' '), ''), new_caption) AS about FROM cap)
"""
MISSING = ", lack AS (SELECT ticket_id, count(*) AS missing FROM beats JOIN tickets t ON t.id = ticket_id WHERE clip_path = '' AND capture_mode = 'native-short' GROUP BY 1)\n"


def of(f, *names):
    """f over the named entities."""
    return lambda s, d: f(*[getattr(b, n)(s, d) for n in names])


QUERIES = {
    "video_names": of(l.video_names, "clips", "tickets", "projects"),
    "video_brand": of(l.video_brand, "clips", "tickets", "projects"),
    "ticket_validation": of(l.ticket_validation, "tickets"),
    "exports": of(l.exports, "clips", "tickets", "projects"),
    "pickups": of(l.pickups, "projects"),
    "next_step": of(l.next_step, "tickets", "beats"),
    "ticket_progress": lambda s, d: l.progress(b.tickets(s, d), b.beats(s, d)).select("id", "n_beats", "n_clips", "n_vo"),
    "intake_board": of(l.intake_board, "intake", "tickets", "beats"),
    "open_beats": of(l.open_beats, "tickets", "beats"),
    "proof_gaps": of(l.proof_gaps, "tickets", "beats"),
    "footage_ready": of(l.footage_ready, "tickets", "beats"),
    "cadence_backlog": of(l.cadence_backlog, "tickets", "brands"),
    "script_gate": of(l.script_gate, "tickets", "beats", "brands"),
    "reel_score": of(l.reel_score, "tickets", "beats"),
    "queue_board": of(l.queue_board, "tickets"),
    "custom_details": of(l.custom_details, "beats"),
    "reel_script": of(l.reel_script, "beats"),
    "plan_next": of(l.plan_next, "tickets"),
    "gate_entry": of(l.gate_entry, "tickets", "brands"),
    "tick_outcome": of(l.tick_outcome, "tickets", "beats", "brands"),
    "post_gate": of(l.post_gate, "tickets"),
    "feed_plan": of(l.feed_plan, "tickets", "brands"),
    "next_slot": of(l.next_slot, "tickets", "brands"),
    "recover_interrupted": of(l.recover_interrupted, "projects"),
    "publish_dry_run": of(l.publications, "tickets"),
    "recover_renders": of(l.recover_renders, "clips"),
    "regenerate_preview": lambda s, d: l.regenerated(b.tickets(s, d), "tighter"),
    "reject_preview": lambda s, d: l.switched(b.tickets(s, d), F.lit(False)),
    "approve_preview": of(l.approved, "tickets"),
    "autopilot_queue": of(l.autopilot_queue, "tickets"),
    "fallback_post_copy": of(l.post_copy, "tickets", "beats"),
    "publish_caption": of(l.publish_caption, "tickets"),
    "migrate_captions": lambda s, d: l.migrated_captions(b.tickets(s, d)).select("id", F.explode("post_meta").alias("platform", "e")).select("id", "platform", "e.*"),
    "next_ordinal": of(l.next_ordinal, "tickets", "beats"),
    "post_meta_fill": of(l.post_meta_fill, "tickets", "beats", "brands"),
}
READY = ", allfilled AS (SELECT ticket_id FROM beats GROUP BY 1 HAVING bool_and(clip_path <> ''))\n"
GATES = CONFIG + ", entry AS (SELECT t.*, coalesce(CASE level WHEN 'supervised' THEN next_stage IN ('scripted', 'ready', 'scheduled') WHEN 'semi' THEN next_stage = 'scheduled' ELSE false END, false) AS gated FROM (SELECT *, " + NEXT + " AS next_stage FROM tickets) t LEFT JOIN config c ON c.brand = t.brand)\n"
ORACLES = {
    "video_names": with_ctes("clips tickets projects", NAMES + "SELECT * FROM names"),
    "video_brand": with_ctes("clips tickets projects", OWNERS + "SELECT * FROM owners"),
    "ticket_validation": with_ctes("tickets", f"SELECT id, r AS rejected_for, r IS NULL AS accepted FROM (SELECT id, CASE WHEN format NOT IN ('reel', 'carousel') THEN 'format' WHEN capture_mode NOT IN ('longform-clip', 'native-short', 'repurpose') THEN 'capture_mode' WHEN stage NOT IN (SELECT unnest({STAGES})) THEN 'stage' END AS r FROM tickets)"),
    "exports": with_ctes("clips tickets projects", NAMES + OWNERS + """, items AS (SELECT 'clip' AS kind, c.id, folder, p.name AS project FROM (SELECT * FROM clips WHERE status = 'rendered') c LEFT JOIN (SELECT id, name FROM projects) p ON p.id = c.project_id UNION ALL SELECT 'reel', id, folder, NULL FROM tickets WHERE clip_url IS NOT NULL)
SELECT i.kind, i.id, name AS title, coalesce(nullif(folder, ''), CASE WHEN is_reel THEN 'Reels' ELSE coalesce(project, 'Clips') END) AS grp, CASE WHEN is_reel THEN coalesce(nullif(brand, ''), 'My videos') ELSE 'Clips' END AS subgroup,
coalesce(nullif(regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ''), CASE WHEN is_reel THEN 'reel_' ELSE 'clip_' END || i.id) || '.mp4' AS filename
FROM items i JOIN names n ON n.kind = i.kind AND n.id = i.id JOIN owners o ON o.kind = i.kind AND o.id = i.id"""),
    "pickups": with_ctes("projects", "SELECT id, name, coalesce(nullif(folder, ''), CASE WHEN mode = 'caption' THEN 'Reels' END) AS folder FROM projects WHERE status = 'ready' ORDER BY last_opened DESC NULLS LAST, id DESC LIMIT 8"),
    "ticket_progress": with_ctes("tickets beats", "SELECT t.id, count(b.id) AS n_beats, count(*) FILTER (clip_path <> '') AS n_clips, count(*) FILTER (voiceover_path <> '') AS n_vo FROM tickets t LEFT JOIN beats b ON b.ticket_id = t.id GROUP BY t.id"),
    "next_step": with_ctes("tickets beats", ", p AS (SELECT t.id, any_value(clip_url) AS u, any_value(capture_mode) AS m, any_value(auto_voiceover) AS a, count(b.id) AS n, count(*) FILTER (clip_path <> '') AS c, count(*) FILTER (voiceover_path <> '') AS v FROM tickets t LEFT JOIN beats b ON b.ticket_id = t.id GROUP BY t.id) SELECT id, CASE WHEN u <> '' THEN 'done' WHEN m <> 'native-short' THEN 'footage' WHEN n = 0 THEN 'script' WHEN c < n THEN 'clips' WHEN NOT a AND v = 0 THEN 'voice' ELSE 'build' END AS step FROM p"),
    "intake_board": with_ctes("intake tickets beats", ", n AS (SELECT * FROM intake WHERE status <> 'discarded' ORDER BY id DESC LIMIT 60) SELECT n.id, filename, n.status, coalesce(nullif(hook_text, ''), angle) AS ticket, substr(spoken_line, 1, 40) AS beat FROM n LEFT JOIN tickets t ON t.id = n.ticket_id LEFT JOIN beats b ON b.id = n.beat_id"),
    "open_beats": with_ctes("tickets beats", "SELECT ticket_id, b.id AS beat_id, order_index, coalesce(nullif(spoken_line, ''), caption) AS line, coalesce(nullif(hook_text, ''), nullif(angle, ''), 'video ' || t.id) AS ticket_label FROM beats b JOIN tickets t ON t.id = ticket_id WHERE t.stage IN ('outlier', 'scripted', 'staged', 'sourced') AND capture_mode = 'native-short' AND clip_path = '' AND regexp_matches(coalesce(nullif(spoken_line, ''), caption), '\\S')"),
    "proof_gaps": with_ctes("tickets beats", "SELECT id FROM tickets t WHERE EXISTS (SELECT 1 FROM beats b WHERE b.ticket_id = t.id AND is_proof_beat AND clip_path = '')"),
    "footage_ready": with_ctes("tickets beats", READY + "SELECT id FROM tickets WHERE id IN (SELECT ticket_id FROM allfilled)"),
    "cadence_backlog": with_ctes("tickets", CONFIG + BACKLOG + "SELECT * FROM backlog"),
    "script_gate": with_ctes("tickets beats", CONFIG + """, p AS (SELECT ticket_id AS tid, sum(len(list_filter(regexp_split_to_array(coalesce(spoken_line, ''), '\\s+'), lambda t: t <> '')))::BIGINT AS n, lower(string_agg(concat_ws(' ', coalesce(spoken_line, ''), coalesce(on_screen_text, ''), coalesce(caption, '')), ' ' ORDER BY order_index, id)) AS blob,
  bool_or(regexp_matches(coalesce(spoken_line, '') || ' ' || coalesce(on_screen_text, ''), '[0-9]')) AS states, bool_or(is_proof_beat) AS proved FROM beats GROUP BY 1),
j AS (SELECT t.id, t.hook_text, p.*, proof_rules, coalesce(n, 0) / 2.5::DOUBLE AS seconds, list_filter(banned, lambda x: contains(blob, x))[1] AS hit FROM tickets t LEFT JOIN p ON tid = t.id LEFT JOIN config c ON c.brand = t.brand),
r AS (SELECT id AS ticket_id, seconds, CASE WHEN n IS NULL THEN 'no scenes were written' WHEN NOT regexp_matches(coalesce(hook_text, ''), '\\S') THEN 'missing a hook (the first line)' WHEN hit IS NOT NULL THEN 'uses an off-brand / non-compliant phrase: "' || hit || '"'
  WHEN coalesce(proof_rules, false) AND states AND NOT proved THEN 'states a real number but no proof scene is marked' WHEN seconds < 4 THEN printf('script too short (~%.0fs of spoken content)', seconds) WHEN seconds > 120 THEN printf('script too long (~%.0fs spoken)', seconds) END AS reason FROM j)
SELECT ticket_id, seconds, reason, reason IS NULL AS passed FROM r"""),
    "reel_score": with_ctes("tickets beats", ", p AS (SELECT ticket_id, count(*) AS n, count(*) FILTER (is_proof_beat) AS q, min_by(spoken_line, order_index) AS o FROM beats GROUP BY 1) SELECT id, greatest(60, least(96, 72 + least(coalesce(n, 0), 8) + least(2 * coalesce(q, 0), 6) + CASE WHEN regexp_matches(coalesce(hook_text, '') || coalesce(o, ''), '\\S') THEN 6 ELSE 0 END)) AS score FROM tickets LEFT JOIN p ON ticket_id = id"),
    "queue_board": with_ctes("tickets", ", l AS (SELECT 'ready' AS lane, id, NULL::TIMESTAMP AS due FROM tickets WHERE stage IN ('assembled', 'ready') AND clip_url <> '' UNION ALL SELECT 'scheduled', id, scheduled_at FROM tickets WHERE stage = 'scheduled' UNION ALL (SELECT 'posted', id, posted_at FROM tickets WHERE stage = 'posted' ORDER BY posted_at DESC NULLS LAST, id LIMIT 20)) SELECT lane, id, strftime(due, '%Y-%m-%d %H:%M') AS at_time FROM l"),
    "custom_details": with_ctes("beats", "SELECT id, trim(on_screen_text) <> '' OR (trim(caption) <> '' AND caption <> spoken_line) AS custom FROM beats"),
    "reel_script": with_ctes("beats", "SELECT ticket_id, string_agg(trim(spoken_line), ' ' ORDER BY order_index) AS script FROM beats WHERE trim(spoken_line) <> '' GROUP BY 1"),
    "plan_next": with_ctes("tickets", f"SELECT id, stage, {NEXT} AS next_stage FROM tickets"),
    "gate_entry": with_ctes("tickets", GATES + "SELECT id, next_stage, gated FROM entry"),
    "tick_outcome": with_ctes("tickets beats", GATES + MISSING + f""", o AS (SELECT e.*, missing, CASE WHEN gate = 'awaiting_footage' AND missing IS NOT NULL THEN 'waiting' WHEN gate IN ('awaiting_approval', 'parked') THEN 'waiting' WHEN stage = 'posted' THEN 'done' WHEN stage = 'staged' AND missing IS NOT NULL THEN 'footage'
  WHEN stage NOT IN ('staged', 'scripted') AND failure IS NOT NULL THEN CASE WHEN tries + 1 > 2 THEN 'parked' ELSE 'retry' END WHEN gated THEN 'gated' ELSE 'advanced' END AS outcome FROM entry e LEFT JOIN lack ON ticket_id = e.id WHERE autopilot)
SELECT id, stage, outcome, CASE WHEN outcome IN ('gated', 'advanced') THEN next_stage ELSE stage END AS stage_after, CASE outcome WHEN 'waiting' THEN gate WHEN 'done' THEN 'done' WHEN 'footage' THEN 'awaiting_footage' WHEN 'parked' THEN 'parked' WHEN 'gated' THEN 'awaiting_approval' END AS gate_after,
CASE outcome WHEN 'footage' THEN missing || ' scene(s) still need footage' WHEN 'parked' THEN failure WHEN 'gated' THEN CASE next_stage WHEN 'scripted' THEN 'review the script' WHEN 'ready' THEN 'review the reel' ELSE 'approve the post' END END AS gate_reason,
CASE WHEN outcome IN ('parked', 'retry') THEN tries + 1 ELSE tries END AS tries_after, CASE WHEN outcome IN ('parked', 'retry') THEN failure END AS last_error FROM o"""),
    "post_gate": with_ctes("tickets", "SELECT id, r AS reason, r IS NULL AS passed FROM (SELECT id, CASE WHEN coalesce(len(platforms), 0) = 0 THEN 'no target platforms are set' ELSE 'missing post copy for ' || list_filter(platforms, lambda p: NOT coalesce(p = own_platform AND regexp_matches(own_caption || own_title, '\\S'), false))[1] END AS r FROM tickets)"),
    "feed_plan": with_ctes("tickets", CONFIG + BACKLOG + ", tot AS (SELECT brand, count(*) AS n FROM tickets GROUP BY 1) SELECT b.brand, missing, angles[coalesce(n, 0) % len(angles) + 1] AS angle FROM backlog b JOIN config c ON c.brand = b.brand LEFT JOIN tot ON tot.brand = b.brand WHERE feed AND missing > 0 AND len(angles) > 0"),
    "next_slot": with_ctes("tickets", CONFIG + "SELECT id, g::BIGINT AS gap_hours, strftime(base_at + to_hours(g), '%Y-%m-%d %H:%M') AS slot FROM (SELECT id, coalesce(scheduled_at, posted_at) AS base_at, greatest(6, 168 // greatest(1, target))::INT AS g FROM tickets t JOIN config c ON c.brand = t.brand) WHERE base_at IS NOT NULL"),
    "recover_interrupted": with_ctes("projects", f"SELECT id, CASE WHEN lost THEN 'error' ELSE status END AS status, CASE WHEN lost THEN '{l.INTERRUPTED}' END AS error, CASE WHEN lost THEN 'Interrupted: ' || coalesce(stage, 'starting') ELSE stage END AS stage, lost AS recovered FROM (SELECT *, status IN ('created', 'ingesting', 'transcribing', 'analyzing') AS lost FROM projects)"),
    "publish_dry_run": with_ctes("tickets", ", k AS (SELECT id, CASE WHEN scheduled_at IS NULL THEN 'post' ELSE 'schedule' END AS action, list_filter(coalesce(platforms, []), lambda p: p IN ('tt', 'ig', 'yt')) AS ps FROM tickets), e AS (SELECT id, action, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE ['tt', 'ig', 'yt'] END) AS platform FROM k) SELECT id, platform, action, 'DRY-RUN — would ' || action || ' to ' || CASE platform WHEN 'tt' THEN 'TikTok' WHEN 'ig' THEN 'Instagram' ELSE 'YouTube' END AS result FROM e"),
    "recover_renders": with_ctes("clips", f"SELECT id, CASE WHEN lost THEN 'error' ELSE status END AS status, CASE WHEN lost THEN '' ELSE stage END AS stage, CASE WHEN lost THEN '{l.RENDER_LOST}' END AS error, lost AS recovered FROM (SELECT *, status = 'rendering' AS lost FROM clips)"),
    "regenerate_preview": with_ctes("tickets", f"SELECT id, {STAGES}[greatest(list_position({STAGES}, stage) - 1, 1)] AS stage, NULL::VARCHAR AS gate, 0::BIGINT AS tries, angle || '  [note: tighter]' AS angle FROM tickets"),
    "reject_preview": with_ctes("tickets", "SELECT id, false AS autopilot, NULL::VARCHAR AS gate FROM tickets"),
    "approve_preview": with_ctes("tickets", "SELECT id, CASE WHEN gate NOT IN ('awaiting_approval', 'awaiting_footage') THEN gate END AS gate FROM tickets"),
    "autopilot_queue": with_ctes("tickets", "SELECT id, coalesce(gate, CASE WHEN stage = 'posted' THEN 'done' ELSE 'running' END) AS kind FROM tickets WHERE autopilot"),
    "fallback_post_copy": with_ctes("tickets beats", COPY + "SELECT id, new_caption AS caption, new_tags AS hashtags, new_title AS title, about AS description FROM copy"),
    "publish_caption": with_ctes("tickets", "SELECT id, coalesce(CASE WHEN own_platform = 'tt' THEN own_caption || ' #own' WHEN own_platform = 'yt' THEN own_title END, nullif(old_caption, ''), nullif(hook_text, ''), angle) AS caption FROM tickets"),
    "migrate_captions": with_ctes("tickets", "SELECT id, own_platform AS platform, own_caption AS caption, own_tags AS hashtags, own_title AS title, '' AS description, '' AS tags FROM tickets WHERE own_platform IS NOT NULL UNION ALL SELECT id, p, CASE WHEN p = 'tt' THEN old_caption ELSE '' END, '', '', '', '' FROM tickets, unnest(['tt', 'ig', 'yt']) u(p) WHERE own_platform IS NULL AND old_caption IS NOT NULL"),
    "next_ordinal": with_ctes("tickets beats", "SELECT t.id AS ticket_id, coalesce(max(order_index), -1) + 1 AS order_index FROM tickets t LEFT JOIN beats b ON b.ticket_id = t.id GROUP BY 1"),
    "post_meta_fill": with_ctes("tickets beats", CONFIG + COPY + """, e AS (SELECT c.*, unnest(CASE WHEN len(platforms) > 0 THEN platforms WHEN len(cadence_platforms) > 0 THEN cadence_platforms ELSE ['tt', 'ig', 'yt'] END) AS platform FROM copy c LEFT JOIN config g ON g.brand = c.brand)
SELECT id, platform, CASE WHEN platform = own_platform THEN own_caption WHEN platform IN ('tt', 'ig') THEN new_caption WHEN platform = 'yt' THEN '' ELSE coalesce(nullif(hook_text, ''), angle) END AS caption, CASE WHEN platform = own_platform THEN own_tags WHEN platform IN ('tt', 'ig') THEN new_tags ELSE '' END AS hashtags,
CASE WHEN platform = own_platform THEN own_title WHEN platform = 'yt' THEN new_title ELSE '' END AS title, CASE WHEN platform IS DISTINCT FROM own_platform AND platform = 'yt' THEN about ELSE '' END AS description, '' AS tags FROM e"""),
}
