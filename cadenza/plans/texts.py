"""Queries over text layout, scripts, matching and shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import layout
from cadenza.operators import matching as m
from cadenza.operators import scripts as sc
from cadenza.operators import transcript as t
from cadenza.plans.ctes import with_ctes
from cadenza.plans.transcripts import LINES
from cadenza.sources import bridge as b


def takes(s, d):
    return b.intake(s, d).select(F.col("id").alias("take_id"), F.col("transcript").alias("text"), "mtime")


def lines(s, d):
    return b.table(s, d, "benchmark").select(F.col("item_id").alias("line_id"), "text")


def batch():
    """The upload that a take came with: here ten, by take."""
    return F.col("take_id") % 10


def scores(s, d):
    return m.match_scores(takes(s, d), lines(s, d))


def caption_widths(s, d):
    """Widths of each caption line's words as they are spoken; strong words are emphasised, some have an emoji."""
    emoji = F.when(F.col("idx") % 11 == 0, "🔥").otherwise("")
    w = b.words(s, d).withColumn("em", layout.word_em(F.upper("word"), sc.strong(F.col("word")), emoji))
    return t.line_values(w, "em").withColumnRenamed("values", "widths")


def fit(s, d):
    # inline works a struct out once, its fields would do so each
    x = caption_widths(s, d).select("project_id", "first_idx", F.inline(F.array(layout.fit_layout(F.col("widths")))))
    return x.withColumn("scale", F.round("scale", 6))


def wrap(s, d):
    """Each clip's whole hook and title, between blank lines, as a title's lines."""
    text = F.concat(F.lit("\n \n"), "hook", F.lit("\r\n\n"), "title", F.lit("\n"))
    c = b.clips(s, d).select("id", layout.wrapped(text, 18).alias("lines"))
    return c.select("id", F.posexplode("lines").alias("k", "line"))


def crops(s, d):
    c = b.clips(s, d)
    w = F.when(F.col("id") % 2 == 0, 1920).otherwise(1080).cast("long")
    h = F.when(F.col("id") % 2 == 0, 1080).otherwise(1920).cast("long")
    one = lambda a, z: layout.crop_window(w, h, a, z, (F.col("id") % 11) / 10.0)
    x = c.select("id", F.when(F.col("id") % 3 == 0, one(9, 16)).when(F.col("id") % 3 == 1, one(1, 1)).otherwise(one(4, 5)).alias("c"))
    return x.select("id", "c.*")


def effects(s, d):
    x = sc.suggested(b.words(s, d))
    return x.select("project_id", "idx", "emphasis", "emoji", F.col("zoom.t").alias("zoom_t"), F.col("zoom.duration").alias("zoom_for"), F.col("sfx.t").alias("sfx_t"), F.col("sfx.name").alias("sfx_name"))


def scripts(s, d):
    """A script for each ticket: with BEAT lines and labels, numbered, in paragraphs, or a line for each beat."""
    said = F.regexp_replace(F.trim("spoken_line"), "[\n\r]+", " ")
    n, kind = F.col("order_index") + 1, F.col("ticket_id") % 4
    labels = F.concat(F.lit("Spoken: "), said, F.lit("\nOn-screen: "), F.trim("on_screen_text"), F.when(F.col("order_index") % 3 == 1, "\nProof: yes").when(F.col("order_index") % 3 == 2, "\n- B-roll: hands").otherwise("\nCaption: short"))
    block = F.when(kind == 0, F.concat(F.lit("BEAT "), n, F.lit(":\n"), labels, F.lit("\n"))).when(kind == 1, F.concat(n, F.lit(". "), said)).when(kind == 2, F.concat(labels, F.lit("\n"))).otherwise(said)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", block.alias("x")))), lambda y: y["x"]), "\n")
    return b.beats(s, d).groupBy("ticket_id").agg(F.concat(F.lit("\nHOOK: watch this\r\n"), text).alias("text"))


def parse(s, d):
    texts = scripts(s, d)
    return sc.parsed(texts).join(sc.hooks(texts), "ticket_id", "left")


def align(s, d):
    """Each beat's known words against the same words heard evenly over ten seconds with every fifth one lost."""
    toks = F.filter(F.split(F.col("spoken_line"), r"\s+"), lambda x: x != "")
    x = b.beats(s, d).select("id", toks.alias("known")).where(F.size("known") > 0)
    n = F.size("known")
    some = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k % 5 != 4) & (F.col("id") % 7 != 0))
    return m.aligned(x.select("id", "known", F.transform(some, lambda k: F.get("known", k)).alias("heard"), F.transform(some, lambda k: k * 10.0 / n).alias("starts"), F.lit(10.0).alias("duration")))


def tracks(s, d):
    """Shots of each track with a center from their place in it."""
    x = m.shot_cuts(b.frames(s, d))
    return m.folded_shots(x.withColumn("center", F.when(F.col("start_ms") % 1750 != 0, (F.col("start_ms") / 250 % 23) / 22.0)))


QUERIES = {
    "take_line_pairs": lambda s, d: m.bounded_pairs(takes(s, d), lines(s, d)),
    "vocab_containment": lambda s, d: m.contained_lines(takes(s, d), lines(s, d)),
    "match_score": scores,
    "assign_takes": lambda s, d: m.assign(scores(s, d), batch()),
    "leftover_beats": lambda s, d: m.leftovers(takes(s, d), m.assign(scores(s, d), batch()), batch()),
    "first_sentence": lambda s, d: takes(s, d).select("take_id", m.first_sentence(F.col("text")).alias("sentence")),
    "align_words": align,
    "shot_cuts": lambda s, d: m.shot_cuts(b.frames(s, d)),
    "shot_track": tracks,
    "text_em": lambda s, d: b.beats(s, d).select("id", layout.text_em(F.concat("spoken_line", F.when(F.col("id") % 3 == 0, " 🔥—").otherwise(""))).cast("long").alias("em")),
    "fit_layout": fit,
    "wrap_title": wrap,
    "crop_window": crops,
    "effects_suggest": effects,
    "effect_counts": lambda s, d: sc.effect_counts(sc.suggested(b.words(s, d))),
    "parse_script": parse,
}
TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9'' ]', ' ', 'g'), ' '), lambda x: x <> '')"
PAIRS = f"""WITH tk AS (SELECT doc_id AS take_id, n_chars AS mtime, {TOKENS.format("text")} AS ts FROM documents), ln AS (SELECT item_id AS line_id, {TOKENS.format("text")} AS ts FROM benchmark),
ta AS (SELECT take_id, t, count(*) AS c, any_value(n) AS n FROM (SELECT take_id, unnest(ts) AS t, len(ts) AS n FROM tk) GROUP BY 1, 2), lb AS (SELECT line_id, t, count(*) AS c, any_value(n) AS n FROM (SELECT line_id, unnest(ts) AS t, len(ts) AS n FROM ln) GROUP BY 1, 2),
pr AS (SELECT take_id, line_id, sum(least(ta.c, lb.c)) AS m, count(*) AS k, any_value(ta.n) AS la, any_value(lb.n) AS lb FROM ta JOIN lb USING (t) GROUP BY 1, 2),
sc AS (SELECT take_id, line_id, k / len(list_distinct(ts))::DOUBLE AS containment, greatest(0.9::DOUBLE * (k / len(list_distinct(ts))::DOUBLE), 2.0::DOUBLE * m / (la + lb)) AS bound FROM pr JOIN ln USING (line_id))
"""
quoted = lambda x: x.replace("'", "''")
EM = "(length({0}) * 611 + " + " + ".join(f"{w - layout.OTHER_EM} * (length({{0}}) - length(regexp_replace({{0}}, '{quoted(layout.char_class(c))}', '', 'g')))" for w, c in layout.BY_WIDTH.items()) + f" + {layout.EMOJI_EM - layout.OTHER_EM} * (length({{0}}) - length(regexp_replace({{0}}, '{quoted(layout.EMOJI).replace('{', '{{').replace('}', '}}')}', '', 'g'))))"
STRONG = "(regexp_matches(word, '\\p{Nd}') OR (upper(word) = word AND lower(word) <> word AND length(word) > 2) OR length(regexp_replace(lower(word), '[^a-z]', '', 'g')) >= 8)"
SCALE = "CASE WHEN {0} * 126 / 1000.0::DOUBLE + 20 <= 920 THEN 1.0::DOUBLE ELSE greatest(0.45::DOUBLE, 900 / ({0} * 126 / 1000.0::DOUBLE)) END"
ROW = "(list_sum({0}) + 278 * (len({0}) - 1))"
FIT = with_ctes(
    "words",
    LINES
    + f""", ws AS (SELECT project_id, min(idx) AS first_idx, list({EM.format("shown")} * CASE WHEN {STRONG} THEN 118 ELSE 112 END / 100.0::DOUBLE ORDER BY idx) AS w FROM (SELECT *, upper(replace(word, 'ß', 'ss')) || CASE WHEN idx % 11 = 0 THEN ' 🔥' ELSE '' END AS shown FROM pt) GROUP BY project_id, seg, part),
one AS (SELECT *, {SCALE.format(ROW.format("w"))} AS k1 FROM ws),
two AS (SELECT project_id, first_idx, k, {SCALE.format("greatest(" + ROW.format("w[1:k]") + ", " + ROW.format("w[k + 1:]") + ")")} AS s FROM one, unnest(range(1, len(w))) u(k) WHERE k1 < 0.8 AND len(w) >= 2),
best AS (SELECT t.project_id, t.first_idx, max(s) AS s, arg_min(k, (-round(s, 9), k)) AS k FROM two t GROUP BY 1, 2)
SELECT project_id, first_idx, round(CASE WHEN b.s > k1 + 1e-9 THEN b.s ELSE k1 END, 6) AS scale, CASE WHEN b.s > k1 + 1e-9 THEN b.k END AS split FROM one LEFT JOIN best b USING (project_id, first_idx)""",
)
# each match of the pattern is a line
FILL = f"string_split(regexp_replace(regexp_replace(trim(regexp_replace(p, '{layout.BLANKS}+', ' ', 'g')), '{layout.filling(18)}', '\\1' || chr(10), 'g'), '\\n\\z', ''), chr(10))"
WRAP = with_ctes("clips", f", tx AS (SELECT id, string_split(replace(chr(10) || ' ' || chr(10) || hook || chr(13) || chr(10) || chr(10) || title || chr(10), chr(13), ''), chr(10)) AS ps FROM clips), ls AS (SELECT id, flatten(list_transform(ps, lambda p: {FILL})) AS l FROM tx), nb AS (SELECT id, l, list_filter(list_transform(l, lambda x, i: CASE WHEN x <> '' THEN i END), lambda i: i IS NOT NULL) AS said FROM ls), tr AS (SELECT id, l[list_min(said):list_max(said)] AS l FROM nb WHERE len(said) > 0) SELECT id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM tr")
SCRIPTS = """, sx AS (SELECT ticket_id, order_index AS o, ticket_id % 4 AS kind, order_index + 1 AS n, regexp_replace(trim(spoken_line), '[\\n\\r]+', ' ', 'g') AS said, trim(on_screen_text) AS scr FROM beats),
lb AS (SELECT *, 'Spoken: ' || said || chr(10) || 'On-screen: ' || scr || CASE o % 3 WHEN 1 THEN chr(10) || 'Proof: yes' WHEN 2 THEN chr(10) || '- B-roll: hands' ELSE chr(10) || 'Caption: short' END AS labels FROM sx),
scripts AS (SELECT ticket_id, chr(10) || 'HOOK: watch this' || chr(13) || chr(10) || string_agg(CASE kind WHEN 0 THEN 'BEAT ' || n || ':' || chr(10) || labels || chr(10) WHEN 1 THEN n || '. ' || said WHEN 2 THEN labels || chr(10) ELSE said END, chr(10) ORDER BY o) AS text FROM lb GROUP BY 1)
"""
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
FIELD = "coalesce(" + ", ".join(f"CASE WHEN name IN ({', '.join(repr(x) for x in v)}) THEN '{k}' END" for k, v in sc.LABELS.items()) + ")"
PARSED = f""", sl AS (SELECT ticket_id, generate_subscripts(l, 1) AS k, {STRIP.format("unnest(l)")} AS line FROM (SELECT ticket_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM scripts)),
bg AS (SELECT *, line <> '' AND max(CASE WHEN line <> '' AND NOT regexp_matches(line, '{sc.HOOK}') THEN 1 ELSE 0 END) OVER (PARTITION BY ticket_id ORDER BY k) = 0 AS is_hook FROM sl),
hooks AS (SELECT ticket_id, arg_max({STRIP.format(f"regexp_extract(line, '{sc.HOOK}', 1)")}, k) AS hook FROM bg WHERE is_hook GROUP BY 1),
dl AS (SELECT *, CASE WHEN line = '' THEN NULL WHEN regexp_matches(line, '{sc.BEAT}') THEN '' WHEN regexp_matches(line, '{sc.BEAT_WITH}') THEN {STRIP.format(f"regexp_extract(line, '{sc.BEAT_WITH}', 1)")} WHEN regexp_matches(line, '{sc.HEADING}') THEN {STRIP.format(f"regexp_extract(line, '{sc.HEADING}', 1)")} WHEN regexp_matches(line, '{sc.RULE}') THEN ''
  WHEN regexp_matches(line, '{sc.NUMBERED}') THEN {STRIP.format(f"regexp_extract(line, '{sc.NUMBERED}', 1)")} END AS rest FROM bg WHERE NOT is_hook),
bk AS (SELECT *, count(rest) OVER (PARTITION BY ticket_id) > 0 AS delimited, count(rest) OVER w AS block, sum(CASE WHEN line <> '' AND coalesce(prev, '') = '' THEN 1 ELSE 0 END) OVER w AS para FROM (SELECT *, lag(line) OVER (PARTITION BY ticket_id ORDER BY k) AS prev FROM dl) WINDOW w AS (PARTITION BY ticket_id ORDER BY k)),
nm AS (SELECT * EXCLUDE (line), coalesce(rest, line) AS line, regexp_replace(replace(lower({STRIP.format(f"regexp_extract(coalesce(rest, line), '{sc.LABELLED}', 1)")}), '-', ' '), '\\s+', ' ', 'g') AS name FROM bk WHERE coalesce(rest, line) <> ''),
fd AS (SELECT *, {FIELD} AS field FROM nm),
vl AS (SELECT *, CASE WHEN delimited THEN block WHEN max(para) OVER t = min(para) OVER t AND count(field) OVER t = 0 THEN k ELSE para END AS blk, CASE WHEN field IS NOT NULL THEN {STRIP.format(f"regexp_extract(line, '{sc.LABELLED}', 2)")} ELSE line END AS v FROM fd WINDOW t AS (PARTITION BY ticket_id)),
gr AS (SELECT ticket_id, blk, {", ".join(f"coalesce(string_agg(v, ' ' ORDER BY k) FILTER (field = '{f}' AND v <> ''), '') AS {f}_" for f in sc.LABELS if f != "proof")}, coalesce(string_agg(v, ' ' ORDER BY k) FILTER (field IS NULL AND v <> ''), '') AS plain, arg_max(lower(v) NOT IN ('no', 'false', 'n', '0', 'none', 'off'), k) FILTER (field = 'proof') AS proof FROM vl GROUP BY 1, 2),
sp AS (SELECT *, concat_ws(' ', nullif(spoken_line_, ''), nullif(plain, '')) AS said FROM gr),
cp AS (SELECT *, coalesce(nullif(caption_, ''), said) AS cap FROM sp)
SELECT c.ticket_id, row_number() OVER (PARTITION BY c.ticket_id ORDER BY blk) - 1 AS order_index, said AS spoken_line, on_screen_text_ AS on_screen_text, cap AS caption, shot_cue_ AS shot_cue, coalesce(proof, regexp_matches(concat_ws(' ', said, cap, on_screen_text_), '\\p{{Nd}}')) AS is_proof_beat, hook FROM cp c LEFT JOIN hooks h ON h.ticket_id = c.ticket_id WHERE said <> '' OR on_screen_text_ <> '' OR cap <> '' OR shot_cue_ <> ''"""
FACES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sc.EMOJI.items()) + "}"
EFFECTS = with_ctes("words", f", st AS (SELECT *, {STRONG} AS strong, {FACES}[regexp_replace(lower(word), '[^a-z]', '', 'g')] AS face FROM words), n AS (SELECT *, sum(strong::INT) OVER w AS k, count(face) OVER w AS e FROM st WINDOW w AS (PARTITION BY project_id ORDER BY idx)) SELECT project_id, idx, strong AND k <= 12 AS emphasis, CASE WHEN e <= 6 THEN face END AS emoji, CASE WHEN strong AND k <= 4 THEN round(start_ms / 1000.0::DOUBLE, 3) END AS zoom_t, CASE WHEN strong AND k <= 4 THEN greatest(400, end_ms - start_ms + 500) / 1000.0::DOUBLE END AS zoom_for, CASE WHEN strong AND k <= 3 THEN round(start_ms / 1000.0::DOUBLE, 3) END AS sfx_t, CASE WHEN strong AND k <= 3 THEN 'whoosh' END AS sfx_name FROM n WHERE strong AND k <= 12 OR (e <= 6 AND face IS NOT NULL)")
ORACLES = {
    "take_line_pairs": PAIRS + "SELECT * FROM sc WHERE bound >= 0.55",
    "vocab_containment": PAIRS + "SELECT take_id, line_id, containment FROM sc WHERE containment >= 0.5",
    "text_em": with_ctes("beats", ", sp AS (SELECT id, spoken_line || CASE WHEN id % 3 = 0 THEN ' 🔥—' ELSE '' END AS s FROM beats) SELECT id, " + EM.format("s") + "::BIGINT AS em FROM sp"),
    "fit_layout": FIT,
    "wrap_title": WRAP,
    "crop_window": with_ctes("clips", ", g AS (SELECT id, CASE WHEN id % 2 = 0 THEN 1920 ELSE 1080 END AS sw, CASE WHEN id % 2 = 0 THEN 1080 ELSE 1920 END AS sh, [9, 1, 4][id % 3 + 1] AS a, [16, 1, 5][id % 3 + 1] AS z, (id % 11) / 10.0::DOUBLE AS c FROM clips), s AS (SELECT *, (CASE WHEN sw * z > sh * a THEN least(sw, round_even(sh * a / z::DOUBLE, 0)) ELSE sw END)::BIGINT AS w, (CASE WHEN sw * z > sh * a THEN sh ELSE least(sh, round_even(sw * z / a::DOUBLE, 0)) END)::BIGINT AS h FROM g) SELECT id, w, h, greatest(0, least(sw - w, round_even(c * sw - w / 2.0::DOUBLE, 0)))::BIGINT AS x, (sh - h) // 2 AS y FROM s"),
    "effects_suggest": EFFECTS,
    "effect_counts": f"SELECT project_id, count(*) FILTER (emphasis) AS emphasis, count(emoji) AS emoji, count(zoom_t) AS zoom, count(sfx_t) AS sfx FROM ({EFFECTS}) GROUP BY 1",
    "parse_script": with_ctes("beats", SCRIPTS + PARSED),
}
