"""The entities of sources/bridge.py in DuckDB SQL, as common table expressions."""

from __future__ import annotations

CTES = {
    "words": """
own AS (
    SELECT doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
      SELECT doc_id, line_no, regexp_split_to_array(line, '[ \\t\\r]+') AS ws FROM (
        SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))),
toks AS (SELECT doc_id AS project_id, line_no, pos * 2 AS pos, word FROM own WHERE word <> '' UNION ALL
  SELECT doc_id, line_no, pos * 2 - 1, ['How', 'um,', 'You', 'secret', 'but', 'three', 'Uh', 'never', 'money', 'because', '7', 'What', 'hmm', 'your'][(line_no + pos - 1) % 14 + 1] FROM own WHERE word <> '' AND (pos - 1) % 17 = 0),
words AS (SELECT project_id, idx, line_no, word, idx * 400 + ends * 300 + line_no * 1500 AS start_ms, idx * 400 + ends * 300 + line_no * 1500 + 400 AS end_ms FROM (
    SELECT project_id, line_no, word, row_number() OVER w - 1 AS idx,
      coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ends
    FROM toks WINDOW w AS (PARTITION BY project_id ORDER BY line_no, pos)))""",
    "perf_log": """
perf_log AS (SELECT event_id AS id, CASE WHEN user_id % 50 <> 23 AND (user_id % 10 = 7 OR user_id % 2 = 1) THEN user_id END AS ticket_id,
    CASE WHEN user_id % 10 <> 7 THEN CASE WHEN user_id % 2 = 0 THEN 'clip' ELSE 'reel' END END AS video_kind,
    CASE WHEN user_id % 10 <> 7 AND user_id % 50 <> 23 THEN user_id END AS video_id,
    CASE WHEN k % 7 = 6 THEN '' ELSE ['tt', 'ig', 'yt'][k % 3 + 1] END AS platform,
    (event_type = 'view')::BIGINT AS views, (event_type = 'signup')::BIGINT AS follows, (event_type = 'purchase')::BIGINT AS saves,
    (event_type = 'click')::BIGINT AS sends, ts AS captured_at
  FROM (SELECT *, (props::JSON ->> '$.k')::INT AS k FROM events))""",
    "perf": """
perf AS (SELECT min(id) AS id, ticket_id, video_kind, video_id, platform, sum(views)::BIGINT AS views, sum(follows)::BIGINT AS follows,
    sum(saves)::BIGINT AS saves, sum(sends)::BIGINT AS sends, max(captured_at) AS captured_at
  FROM perf_log GROUP BY ticket_id, video_kind, video_id, platform)""",
    "clips": """
clips AS (SELECT d.doc_id AS id, regexp_replace(source, '[^0-9]', '', 'g')::BIGINT AS project_id, d.doc_id % 13 AS idx,
    CASE WHEN quality = 1 THEN 'rendered' WHEN d.doc_id % 10 = 3 THEN 'rendering' ELSE 'suggested' END AS status, CASE WHEN d.doc_id % 10 = 3 THEN 'Cutting' END AS stage, CASE WHEN d.doc_id % 7 = 0 THEN '[]' END AS markers,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE regexp_extract(text, '^[^\\n]*', 0) END AS title,
    CASE WHEN d.doc_id % 4 = 1 THEN '' ELSE regexp_extract(text, '^[^.!?\\n]*[.!?]?', 0) END AS hook,
    CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE lang END AS brand, CASE WHEN d.doc_id % 4 = 0 THEN 'F' || lang ELSE '' END AS folder,
    ['clean', 'bold', 'cinematic', 'neon', 'minimal'][d.doc_id % 5 + 1] AS preset, (n_chars % 100)::DOUBLE AS score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "projects": """
projects AS (SELECT id, 'Project ' || id AS name, CASE WHEN id % 3 = 0 THEN 'caption' ELSE 'moments' END AS mode, CASE WHEN id % 2 = 0 THEN 'en' ELSE '' END AS brand,
    CASE WHEN id % 2 = 0 THEN 'ready' ELSE ['created', 'ingesting', 'transcribing', 'analyzing', 'error'][(id - 1) // 2 % 5 + 1] END AS status, CASE WHEN id % 4 = 1 THEN 'Listening' END AS stage,
    CASE WHEN id % 5 = 0 THEN 'Archive' ELSE '' END AS folder, CASE WHEN id % 6 = 1 THEN id * 10 END AS last_opened
  FROM (SELECT DISTINCT regexp_replace(source, '[^0-9]', '', 'g')::BIGINT AS id FROM documents))""",
    "beats": """
beats AS (SELECT conv_id * 1000 + turn AS id, conv_id AS ticket_id, turn AS order_index, CASE WHEN turn % 5 = 4 OR (turn = 0 AND conv_id % 14 = 0) THEN ' ' ELSE text END AS spoken_line,
    CASE WHEN turn % 4 = 0 THEN 'note' ELSE ' ' END AS on_screen_text,
    CASE WHEN turn % 3 = 0 THEN regexp_extract(text, '^[^.!?\\n]*[.!?]?', 0) WHEN turn % 5 = 4 THEN ' ' ELSE text END AS caption,
    CASE WHEN role = 'user' OR conv_id % 3 = 0 THEN 'clip' || turn ELSE '' END AS clip_path, CASE WHEN turn % 3 = 0 THEN 'vo' || turn END AS voiceover_path,
    regexp_matches(text, '[0-9]') OR turn % 6 = 5 AS is_proof_beat FROM conversations WHERE conv_id % 13 <> 12)""",
    "tickets": """
tickets AS (SELECT conv_id AS id, ['en', 'fr', 'de', 'es'][conv_id // 8 % 4 + 1] AS brand,
    ['outlier', 'scripted', 'staged', 'sourced', 'assembled', 'ready', 'scheduled', 'posted'][conv_id % 8 + 1] AS stage, 'angle ' || conv_id % 6 AS angle,
    CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE regexp_extract(text, '^[^.!?\\n]*[.!?]?', 0) END AS hook_text, ['reel', 'carousel', 'story'][conv_id % 3 + 1] AS format,
    ['native-short', 'native-short', 'longform-clip', 'repurpose', 'unknown'][conv_id % 5 + 1] AS capture_mode, conv_id % 20 AS project_id,
    CASE WHEN conv_id % 8 >= 4 THEN '/out/' || conv_id || '.mp4' WHEN conv_id % 9 = 0 THEN '' END AS clip_url, CASE WHEN conv_id % 12 = 0 THEN 'F' || conv_id % 5 ELSE '' END AS folder,
    CASE WHEN conv_id % 8 = 6 AND conv_id % 16 = 6 THEN TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) END AS scheduled_at,
    CASE WHEN conv_id % 8 = 7 AND conv_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours((conv_id * 2)::INT) END AS posted_at, conv_id % 3 <> 0 AS autopilot, conv_id % 7 IN (1, 2) AS auto_voiceover,
    CASE WHEN conv_id % 11 = 0 THEN 'awaiting_approval' WHEN conv_id % 11 IN (1, 2) THEN 'awaiting_footage' WHEN conv_id % 11 = 3 THEN 'parked' END AS gate, conv_id % 3 AS tries,
    CASE WHEN conv_id % 5 = 1 THEN 'render produced no file' END AS failure,
    CASE WHEN conv_id % 9 = 0 THEN [] WHEN conv_id % 9 = 1 THEN ['yt', 'tt'] WHEN conv_id % 9 = 2 THEN ['fb', 'ig'] END AS platforms,
    CASE WHEN conv_id % 10 < 4 THEN 'tt' WHEN conv_id % 10 = 4 THEN 'ig' WHEN conv_id % 10 = 5 THEN 'yt' END AS own_platform,
    CASE WHEN conv_id % 10 < 4 THEN 'own ' || conv_id WHEN conv_id % 10 = 4 THEN ' ' ELSE '' END AS own_caption, CASE WHEN conv_id % 10 < 4 THEN '#own' ELSE '' END AS own_tags,
    CASE WHEN conv_id % 10 = 5 THEN 'title ' || conv_id ELSE '' END AS own_title, CASE WHEN conv_id % 10 = 6 THEN 'old ' || conv_id END AS old_caption
  FROM (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id))""",
    "folders": """
folders AS (SELECT row_number() OVER (ORDER BY folder) AS id, folder AS name FROM (SELECT DISTINCT folder FROM tickets WHERE folder <> ''))""",
    "errors": """
errors AS (SELECT conv_id * 1000 + turn AS id, concat_ws(': ', ['HTTP Error 403: Forbidden', 'Sign in to confirm you''re not a bot', 'Requested format is not available', 'The read operation timed out', 'Connection reset by peer', 'Private video', 'Please try again later', 'ERROR: use --cookies'][(conv_id * 1000 + turn) % 8 + 1], text) AS message FROM conversations)""",
    "intake": """
intake AS (SELECT doc_id AS id, 'take' || doc_id || '.mov' AS filename, n_chars AS mtime, text AS transcript,
    ['uploaded', 'transcribing', 'matched', 'unmatched', 'discarded', 'assigned', 'error'][doc_id % 7 + 1] AS status,
    CASE WHEN doc_id % 7 IN (2, 5) THEN doc_id % 90 END AS ticket_id, CASE WHEN doc_id % 7 IN (2, 5) THEN doc_id % 90 * 1000 + doc_id % 5 END AS beat_id,
    (doc_id % 100) / 100.0 AS confidence FROM documents)""",
    "sents": """
flagged AS (SELECT *, lead(start_ms) OVER p - end_ms AS gap, row_number() OVER p AS rn,
    sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY project_id) AS terminals, count(*) OVER (PARTITION BY project_id) AS total
  FROM words WINDOW p AS (PARTITION BY project_id ORDER BY idx)),
moded AS (SELECT *, terminals >= greatest(3, total // 40) AS punctuated FROM flagged),
islands AS (SELECT *, coalesce(sum(CASE WHEN CASE WHEN punctuated THEN regexp_matches(word, '[.!?]$') OR gap > 1200 ELSE gap > 600 END THEN 1 ELSE 0 END)
    OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS island FROM moded),
seated AS (SELECT *, CASE WHEN punctuated THEN 0 ELSE (row_number() OVER (PARTITION BY project_id, island ORDER BY idx) - 1) // 14 END AS chunk FROM islands),
grouped AS (SELECT project_id, island, chunk, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY idx) AS text, count(*) AS n FROM seated GROUP BY ALL),
sents AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY island, chunk) - 1 AS sid, start_ms, end_ms, text, n FROM grouped)""",
    "cuts": """
pauses AS (SELECT project_id, end_ms + 150 AS a, nxt - 150 AS b FROM (SELECT *, lead(start_ms) OVER (PARTITION BY project_id ORDER BY idx) AS nxt FROM words) WHERE nxt - end_ms > 1000 AND nxt - end_ms - 300 >= 200),
filled AS (SELECT project_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY project_id) AS last_ms, regexp_replace(lower(word), '[^a-z'']', '', 'g') AS t FROM words),
spans_of_fillers AS (SELECT * FROM filled WHERE t IN ('um', 'umm', 'uhm', 'uh', 'uhh', 'er', 'erm', 'ah', 'ahh', 'hmm', 'hm', 'mhm', 'mm', 'mmm')),
fillers AS (SELECT project_id, greatest(start_ms - 30, 0) AS a, least(end_ms + 30, last_ms) AS b FROM spans_of_fillers),
cuts AS (SELECT * FROM pauses UNION ALL SELECT * FROM fillers)""",
}
#: `beats` of every conversation, with the first turns as they are.
CTES["all_beats"] = CTES["beats"].replace(" WHERE conv_id % 13 <> 12", "").replace(" OR (turn = 0 AND conv_id % 14 = 0)", "")
NEEDS = {"perf": ["perf_log"], "folders": ["tickets"], "sents": ["words"], "cuts": ["words"]}


def with_ctes(names: str, body: str) -> str:
    """WITH the named expressions and what they need, then body; body may begin with further ones after a leading comma."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",".join(CTES[n] for n in order) + "\n" + body
