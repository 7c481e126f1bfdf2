"""Scripts as text to beats, and effects suggested for a transcript's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The labels that a script's lines may carry, by field.
LABELS = {
    "spoken_line": ["spoken", "say", "voiceover", "vo", "line", "script", "narration"],
    "on_screen_text": ["on screen", "onscreen", "text", "overlay", "title"],
    "caption": ["caption", "captions", "cc", "subtitle", "subtitles"],
    "shot_cue": ["shot", "shot cue", "b roll", "broll", "film", "visual", "footage"],
    "proof": ["proof"],
}
NO = ["no", "false", "n", "0", "none", "off"]
# Patterns of a script's lines: a label with its value, the hook, and the four ways to begin a beat.
LABELLED = r"^[-*•]?\s*([A-Za-z][A-Za-z \-/]{1,20})\s*[:\-]\s*(.*)$"
HOOK = r"(?i)^hook\s*[:\-]\s*(.+)$"
BEAT = r"(?i)^beat(?:[ \t]+|[ \t]*(?:\d+[ \t]*[:.)\-]?|[:.)\-])[ \t]*)?$"
BEAT_WITH = r"(?i)^beat[ \t]*(?:\d+[ \t]*[:.)\-]?|[:.)\-])[ \t]*(.*)$"
HEADING, RULE, NUMBERED = r"^#{1,6}\s+(.*)$", r"^-{3,}$", r"^\d+[.)]\s+(.*)$"

#: Names of sounds, and the emoji of words.
SOUNDS = ["whoosh", "pop", "ding", "swoosh"]
EMOJI = {
    "money": "💰", "cash": "💰", "dollar": "💵", "free": "🆓", "fire": "🔥", "hot": "🔥",
    "best": "🏆", "win": "🏆", "love": "❤️", "heart": "❤️", "stop": "✋", "warning": "⚠️",
    "sugar": "🍬", "water": "💧", "fast": "⚡", "energy": "⚡", "brain": "🧠", "time": "⏰",
    "secret": "🤫", "wow": "🤯", "shock": "🤯", "food": "🍽️", "health": "💪", "strong": "💪",
}
EMPHASISED, EMOJIS, ZOOMS, SFX, ZOOM_SCALE = 12, 6, 4, 3, 1.15


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def delimiter(line: Column) -> Column:
    """What follows a line's beginning of a beat, possibly nothing; null where it begins none."""
    group = lambda p: F.when(line.rlike(p), stripped(F.regexp_extract(line, p, 1)))
    return F.coalesce(F.when(line.rlike(BEAT), ""), group(BEAT_WITH), group(HEADING), F.when(line.rlike(RULE), ""), group(NUMBERED))


def label(line: Column) -> Column:
    """The field that a labelled line fills; null for others."""
    name = F.regexp_replace(F.replace(F.lower(stripped(F.regexp_extract(line, LABELLED, 1))), F.lit("-"), F.lit(" ")), r"\s+", " ")
    return F.coalesce(*[F.when(name.isin(names), field) for field, names in LABELS.items()])


def lines_of(texts: DataFrame) -> DataFrame:
    """ticket_id, k, line (stripped), hook: whether the line is one of the hook lines at the top."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    ls = texts.select("ticket_id", F.posexplode(F.split(text, "\n")).alias("k", "raw")).select("ticket_id", "k", stripped(F.col("raw")).alias("line"))
    w = Window.partitionBy("ticket_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(((F.col("line") != "") & ~F.col("line").rlike(HOOK)).cast("int")).over(w)
    return ls.withColumn("hook", (F.col("line") != "") & (begun == 0))


def hooks(texts: DataFrame) -> DataFrame:
    """ticket_id, hook: the last of the hook lines at the top of a script."""
    return lines_of(texts).where("hook").groupBy("ticket_id").agg(F.max_by(stripped(F.regexp_extract("line", HOOK, 1)), "k").alias("hook"))


def parsed(texts: DataFrame) -> DataFrame:
    """ticket_id, order_index, spoken_line, on_screen_text, caption, shot_cue, is_proof_beat: the beats of scripts.

    A script with delimiters has a block for each; without any, for each paragraph, and if it is one paragraph of several lines
    without labels, for each line. Labelled lines fill their fields, others are spoken, after what is labelled so. The caption is
    what is spoken unless given; a beat is a proof if it says so, else if it has a digit. Empty blocks go.
    """
    w = Window.partitionBy("ticket_id").orderBy("k")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("ticket_id")
    said = F.col("line") != ""
    x = lines_of(texts).where("not hook").withColumn("rest", F.when(said, delimiter(F.col("line"))))
    opens = F.col("rest").isNotNull()
    x = x.withColumns({"some": F.max(opens.cast("int")).over(whole) == 1, "para": F.sum((said & (F.coalesce(F.lag("line").over(w), F.lit("")) == "")).cast("int")).over(upto), "block": F.sum(opens.cast("int")).over(upto)})
    x = x.withColumn("line", F.coalesce("rest", "line")).where("line <> ''").withColumn("field", label(F.col("line")))
    alone = ~F.col("some") & (F.max("para").over(whole) == F.min("para").over(whole)) & (F.count("field").over(whole) == 0)
    block = F.when(F.col("some"), F.col("block")).when(alone, F.col("k")).otherwise(F.col("para"))
    x = x.withColumns({"block": block, "value": F.when(F.col("field").isNotNull(), stripped(F.regexp_extract("line", LABELLED, 2))).otherwise(F.col("line"))})

    def joined(which: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(which & (F.col("value") != ""), F.struct("k", "value"))))
        return F.array_join(F.transform(found, lambda y: y["value"]), " ")

    fields = {f: joined(F.col("field") == f) for f in LABELS if f != "proof"} | {"plain": joined(F.col("field").isNull())}
    proof = F.max_by(F.when(F.col("field") == "proof", ~F.lower("value").isin(NO)), F.when(F.col("field") == "proof", F.col("k")))
    g = x.groupBy("ticket_id", "block").agg(*[c.alias(f) for f, c in fields.items()], proof.alias("proof"))
    spoken = F.concat_ws(" ", F.nullif("spoken_line", F.lit("")), F.nullif("plain", F.lit("")))
    g = g.withColumn("spoken_line", spoken).withColumn("caption", F.coalesce(F.nullif("caption", F.lit("")), "spoken_line"))
    g = g.where("spoken_line <> '' or on_screen_text <> '' or caption <> '' or shot_cue <> ''")
    counts = F.concat_ws(" ", "spoken_line", "caption", "on_screen_text").rlike(r"\p{Nd}")
    order = F.row_number().over(Window.partitionBy("ticket_id").orderBy("block")) - 1
    return g.select("ticket_id", order.cast("long").alias("order_index"), "spoken_line", "on_screen_text", "caption", "shot_cue", F.coalesce("proof", counts).alias("is_proof_beat"))


def strong(word: Column) -> Column:
    """Words worth a punch: with a digit, in capitals (three at least), or of eight letters or more."""
    capitals = (F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) > 2)
    # the pattern can only take characters away
    long = (F.length(F.lower(word)) >= 8) & (F.length(F.regexp_replace(F.lower(word), "[^a-z]", "")) >= 8)
    return word.rlike(r"\p{Nd}") | capitals | long


#: How many scenes a prompt may ask for, and how many it asks for otherwise.
LEAST_SCENES, MOST_SCENES, SCENES = 2, 12, 5


def scenes_asked(n: Column) -> Column:
    """A number of scenes within its bounds; halves round up, and what isn't a number is the usual one."""
    return F.greatest(F.lit(LEAST_SCENES), F.least(F.lit(MOST_SCENES), F.floor(F.coalesce(F.nullif(n.try_cast("double"), F.lit(float("nan"))), F.lit(float(SCENES))) + 0.5))).cast("int")


def effect_counts(effects: DataFrame) -> DataFrame:
    """How many of each effect a project was given: project_id, emphasis, emoji, zoom, sfx."""
    return effects.groupBy("project_id").agg(F.count_if("emphasis").alias("emphasis"), F.count("emoji").alias("emoji"), F.count("zoom").alias("zoom"), F.count("sfx").alias("sfx"))


def suggested(words: DataFrame) -> DataFrame:
    """Effects of each project's words, without a language model: project_id, idx, emphasis, emoji, zoom struct(t, scale, duration) and
    sfx struct(t, name). The first strong words are emphasised, the first of these zoomed at and heard; known words get an emoji."""
    w = words.where("trim(word) <> ''").withColumns({"strong": strong(F.trim("word")), "face": F.create_map(*[F.lit(x) for kv in EMOJI.items() for x in kv])[F.regexp_replace(F.lower("word"), "[^a-z]", "")]})
    order = Window.partitionBy("project_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumns({"k": F.sum(F.col("strong").cast("int")).over(order), "e": F.sum(F.col("face").isNotNull().cast("int")).over(order)})
    nth = lambda most: F.col("strong") & (F.col("k") <= most)
    t = F.round(F.col("start_ms") / 1000.0, 3).alias("t")
    zoom = F.struct(t, F.lit(ZOOM_SCALE).alias("scale"), F.round(F.greatest(F.lit(400), F.col("end_ms") - F.col("start_ms") + 500) / 1000.0, 3).alias("duration"))
    x = w.select("project_id", "idx", nth(EMPHASISED).alias("emphasis"), F.when(F.col("e") <= EMOJIS, F.col("face")).alias("emoji"), F.when(nth(ZOOMS), zoom).alias("zoom"), F.when(nth(SFX), F.struct(t, F.lit(SOUNDS[0]).alias("name"))).alias("sfx"))
    return x.where("emphasis or emoji is not null")
