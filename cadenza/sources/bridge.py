"""The entities of the domain, derived from the provided tables; plans/ctes.py has the same in SQL.

words from documents, perf from events, clips and projects from documents and labels, tickets and beats
from conversations, lines and takes from benchmark and documents, frames from embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGES = ["outlier", "scripted", "staged", "sourced", "assembled", "ready", "scheduled", "posted"]
PLATFORMS = ["tt", "ig", "yt"]
COPY = ["caption", "hashtags", "title", "description", "tags"]
PRESETS = ["clean", "bold", "cinematic", "neon", "minimal"]
LANGS = ["en", "fr", "de", "es"]
SPICE = ["How", "um,", "You", "secret", "but", "three", "Uh", "never", "money", "because", "7", "What", "hmm", "your"]
#: Brand configurations, as sources.documents.brand_files reads them from a folder.
BRAND_SCHEMA = "brand string, reels_per_week int, autonomy string, feed boolean, angles array<string>, banned array<string>, proof_rules boolean, platforms array<string>"
BRANDS = [
    ("en", 40, "semi", True, ["angle 0", "angle 1", "angle 2"], ["The", "and"], True, ["tt", "ig"]),
    ("fr", None, "hands_off", True, ["angle 3", " "], [], False, []),
    ("de", 0, "off", False, ["angle 1"], ["tion"], True, ["yt"]),
    ("es", 700, "", True, ["angle 4", "angle 5"], ["que", "es"], False, None),
]
FIRST_SENTENCE = "^[^.!?\n]*[.!?]?"
#: The spaces after a word that ends a sentence.
SENTENCE_END = "(?<=[.!?])[ \t\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(BRANDS, BRAND_SCHEMA)


def pick(values: list[str], k: Column) -> Column:
    """values[k mod their number]."""
    return F.array(*map(F.lit, values))[F.pmod(k, F.lit(len(values))).cast("int")]


#: Bytes of a part that words are cut from.
PART_BYTES = 1 << 20


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key while they are whole, so that what is cut from them lies by key already and isn't shuffled again.

    The number of parts grows with what is read: shuffled texts are small, the words in them many, and a part's words are sorted in one task.
    Parts of a large table hold PART_BYTES of it at most, by Spark's estimate of what is read, so that sorted words seldom go to disk.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rows.rdd.getNumPartitions(), size // PART_BYTES)
    return rows.repartition(parts, key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, idx, line_no, word, start_ms, end_ms: every word 400 ms, 300 ms after a sentence's end, 1500 ms after a line feed.

    Before the first and each 17th word of a line comes one of SPICE, so that fillers and the scorer's lexicons occur; all words of the texts stay.
    """
    docs = dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), "text"), "project_id")
    lines = docs.select("project_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return timed(lines.select("project_id", "line_no", F.posexplode(F.split("line", SENTENCE_END)).alias("part", "text")))


def timed(parts: DataFrame) -> DataFrame:
    """The words of lines' parts (project_id, line_no, part, text), with integer times.

    A part ends where a sentence does, so what comes before a word follows from its place in its part and from sums over whole parts: no words are sorted.
    """
    line = Window.partitionBy("project_id", "line_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("project_id").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blank = lambda c: (c == "").cast("int")
    x = parts.select("project_id", "line_no", "part", F.split("text", "[ \t\r]+").alias("words"), F.substring("text", -1, 1).isin(".", "!", "?").cast("int").alias("ends"))
    # only the first of a part's words and the last one can be empty, where a line begins or ends with spaces
    n, lead = F.size("words"), blank(F.get("words", F.lit(0)))
    x = x.withColumns({"n": n, "from": so_far(n, line), "lead": lead}).withColumn("first", F.col("from") + F.col("lead"))
    upto = F.greatest(F.col("first"), F.col("from") + F.col("n") - blank(F.element_at("words", -1)))
    own = lambda p: p + F.floor((p + 16) / 17)  # noqa: E731  # words and added words at places before p
    x = x.withColumn("count", own(upto) - own(F.col("first")))
    x = x.withColumns({"base": so_far("count", earlier) - own(F.col("first")), "before": so_far("ends", earlier)})
    w = x.select("project_id", "line_no", "from", "base", (F.col("before") * 300 + F.col("line_no") * 1500).alias("late"), F.posexplode("words").alias("k", "word")).where("word <> ''")
    pos = F.col("from") + F.col("k")
    w = w.select("project_id", "line_no", "word", "late", pos.alias("pos"), (F.col("base") + own(pos)).alias("idx"))
    added = F.struct("idx", pick(SPICE, F.col("line_no") + F.col("pos")).alias("word"))
    there = F.struct((F.col("idx") + (F.col("pos") % 17 == 0).cast("int")).alias("idx"), "word")
    out = w.select("project_id", "line_no", "late", F.inline(F.when(F.col("pos") % 17 == 0, F.array(added, there)).otherwise(F.array(there))))
    start = F.col("idx") * 400 + F.col("late")
    return out.select("project_id", "idx", "line_no", "word", start.cast("long").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 400)


def perf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, with its counters; every tenth user is a legacy row that has a ticket id only, some users' rows have no id at all."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    legacy, lost = u % 10 == 7, u % 50 == 23
    count = lambda kind: (F.col("event_type") == kind).cast("long")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(~lost & (legacy | (u % 2 == 1)), u).alias("ticket_id"),
        F.when(~legacy, F.when(u % 2 == 0, "clip").otherwise("reel")).alias("video_kind"),
        F.when(~legacy & ~lost, u).alias("video_id"),
        F.when(k % 7 == 6, "").otherwise(pick(PLATFORMS, k)).alias("platform"),
        count("view").alias("views"),
        count("signup").alias("follows"),
        count("purchase").alias("saves"),
        count("click").alias("sends"),
        F.col("ts").cast("timestamp").alias("captured_at"),
    )


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: a row for each video and platform."""
    sums = [F.sum(c).alias(c) for c in ("views", "follows", "saves", "sends")]
    grouped = perf_log(spark, sf_dir).groupBy("ticket_id", "video_kind", "video_id", "platform").agg(F.min("id").alias("id"), *sums, F.max("captured_at").alias("captured_at"))
    return grouped.select("id", "ticket_id", "video_kind", "video_id", "platform", "views", "follows", "saves", "sends", "captured_at")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each document."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"),
        F.regexp_replace("source", "[^0-9]", "").cast("long").alias("project_id"),
        (i % 13).alias("idx"),
        F.when(F.col("quality") == 1, "rendered").when(i % 10 == 3, "rendering").otherwise("suggested").alias("status"),
        F.when(i % 10 == 3, "Cutting").alias("stage"),
        F.when(i % 7 == 0, "[]").alias("markers"),
        F.when(i % 5 == 0, "").otherwise(F.regexp_extract("text", "^[^\n]*", 0)).alias("title"),
        F.when(i % 4 == 1, "").otherwise(F.regexp_extract("text", FIRST_SENTENCE, 0)).alias("hook"),
        F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("brand"),
        F.when(i % 4 == 0, F.concat(F.lit("F"), "lang")).otherwise("").alias("folder"),
        pick(PRESETS, i).alias("preset"),
        (F.col("n_chars") % 100).cast("double").alias("score"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each source."""
    i = F.col("id")
    ids = table(spark, sf_dir, "documents").select(F.regexp_replace("source", "[^0-9]", "").cast("long").alias("id")).distinct()
    return ids.select(
        i,
        F.concat(F.lit("Project "), i).alias("name"),
        F.when(i % 3 == 0, "caption").otherwise("moments").alias("mode"),
        F.when(i % 2 == 0, "en").otherwise("").alias("brand"),
        F.when(i % 2 == 0, "ready").otherwise(pick(["created", "ingesting", "transcribing", "analyzing", "error"], (i - 1) / 2)).alias("status"),
        F.when(i % 4 == 1, "Listening").alias("stage"),
        F.when(i % 5 == 0, "Archive").otherwise("").alias("folder"),
        F.when(i % 6 == 1, i * 10).alias("last_opened"),
    )


def all_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat for each turn of a conversation."""
    t, turn = F.col("text"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("id"),
        F.col("conv_id").alias("ticket_id"),
        turn.alias("order_index"),
        F.when(turn % 5 == 4, " ").otherwise(t).alias("spoken_line"),
        F.when(turn % 4 == 0, F.lit("note")).otherwise(" ").alias("on_screen_text"),
        F.when(turn % 3 == 0, F.regexp_extract(t, FIRST_SENTENCE, 0)).otherwise(F.when(turn % 5 == 4, " ").otherwise(t)).alias("caption"),
        F.when((F.col("role") == "user") | (F.col("conv_id") % 3 == 0), F.concat(F.lit("clip"), turn)).otherwise("").alias("clip_path"),
        F.when(turn % 3 == 0, F.concat(F.lit("vo"), turn)).alias("voiceover_path"),
        (t.rlike("[0-9]") | (turn % 6 == 5)).alias("is_proof_beat"),
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats, of which some tickets have none; of some tickets the first is not spoken."""
    silent = (F.col("order_index") == 0) & (F.col("ticket_id") % 14 == 0)
    return all_beats(spark, sf_dir).where("ticket_id % 13 <> 12").withColumn("spoken_line", F.when(silent, " ").otherwise(F.col("spoken_line")))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for each conversation."""
    i = F.col("conv_id")
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = lambda n: F.timestamp_add("HOUR", n.cast("int"), day)
    eighth = F.floor(i / 8)
    own = lambda caption, tags, title: F.struct(*[F.lit(x).cast("string").alias(c) if isinstance(x, str) else x.alias(c) for c, x in zip(COPY, (caption, tags, title, "", ""), strict=True)])
    meta = lambda p, *entry: F.create_map(F.lit(p), own(*entry))
    return first.select(
        i.alias("id"),
        pick(LANGS, eighth).alias("brand"),
        pick(STAGES, i).alias("stage"),
        F.concat(F.lit("angle "), i % 6).alias("angle"),
        F.when(i % 7 == 0, " ").otherwise(F.regexp_extract("text", FIRST_SENTENCE, 0)).alias("hook_text"),
        pick(["reel", "carousel", "story"], i).alias("format"),
        pick(["native-short", "native-short", "longform-clip", "repurpose", "unknown"], i).alias("capture_mode"),
        (i % 20).alias("project_id"),
        F.when(i % 8 >= 4, F.concat(F.lit("/out/"), i, F.lit(".mp4"))).when(i % 9 == 0, "").alias("clip_url"),
        F.when(i % 12 == 0, F.concat(F.lit("F"), i % 5)).otherwise("").alias("folder"),
        F.when((i % 8 == 6) & (i % 16 == 6), hours(i)).alias("scheduled_at"),
        F.when((i % 8 == 7) & (i % 5 != 0), hours(i * 2)).alias("posted_at"),
        (i % 3 != 0).alias("autopilot"),
        (i % 7).isin(1, 2).alias("auto_voiceover"),
        F.when(i % 11 == 0, "awaiting_approval").when((i % 11).isin(1, 2), "awaiting_footage").when(i % 11 == 3, "parked").alias("gate"),
        (i % 3).alias("tries"),
        F.when(i % 5 == 1, "render produced no file").alias("failure"),
        F.when(i % 9 == 0, F.array().cast("array<string>")).when(i % 9 == 1, F.array(F.lit("yt"), F.lit("tt"))).when(i % 9 == 2, F.array(F.lit("fb"), F.lit("ig"))).alias("platforms"),
        F.when(i % 10 < 4, meta("tt", F.concat(F.lit("own "), i), "#own", "")).when(i % 10 == 4, meta("ig", " ", "", "")).when(i % 10 == 5, meta("yt", "", "", F.concat(F.lit("title "), i))).alias("post_meta"),
        F.when(i % 10 == 6, F.create_map(F.lit("tt"), F.concat(F.lit("old "), i), F.lit("yt"), F.lit(""))).alias("captions"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size) of the files that are there: rendered tickets and beats' footage, but for some that went missing or came out small."""
    t = tickets(spark, sf_dir).where("clip_url <> '' and id % 9 <> 4").select(F.col("clip_url").alias("path"), F.when(F.col("id") % 10 == 6, 500).otherwise(F.col("id") + 20_000).cast("long").alias("size"))
    return t.unionByName(beats(spark, sf_dir).where("clip_path <> '' and order_index % 4 <> 3").select(F.col("clip_path").alias("path"), F.lit(1000).cast("long").alias("size")).distinct())


#: The same in DuckDB, after the expressions of tickets and beats.
FILES_SQL = ", files AS (SELECT clip_url AS path, CASE WHEN id % 10 = 6 THEN 500 ELSE 20000 + id END AS size FROM tickets WHERE clip_url <> '' AND id % 9 <> 4 UNION ALL SELECT DISTINCT clip_path, 1000 FROM beats WHERE clip_path <> '' AND order_index % 4 <> 3)"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each name that tickets have, numbered by name."""
    names = tickets(spark, sf_dir).where("folder <> ''").select(F.col("folder").alias("name")).distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name")


#: What download tools say, before a conversation's text; rates as they are told.
SAYINGS = ["HTTP Error 403: Forbidden", "Sign in to confirm you're not a bot", "Requested format is not available", "The read operation timed out", "Connection reset by peer", "Private video", "Please try again later", "ERROR: use --cookies"]
RATES = ["30000/1001", "25", "0/0", "x", "24/", "-5/1", ""]


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error message for each turn of a conversation."""
    i = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(i.alias("id"), F.concat_ws(": ", pick(SAYINGS, i), "text").alias("message"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut ranges of each project in milliseconds: pauses and fillers."""
    from cadenza.operators import transcript as t

    return t.cuts(words(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order, a track for each label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("hist"))


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded take for each document."""
    i = F.col("doc_id")
    assigned = (i % 7).isin(2, 5)
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("take"), i, F.lit(".mov")).alias("filename"),
        F.col("n_chars").alias("mtime"),
        F.col("text").alias("transcript"),
        pick(["uploaded", "transcribing", "matched", "unmatched", "discarded", "assigned", "error"], i).alias("status"),
        F.when(assigned, i % 90).alias("ticket_id"),
        F.when(assigned, i % 90 * 1000 + i % 5).alias("beat_id"),
        ((i % 100) / 100.0).alias("confidence"),
    )
