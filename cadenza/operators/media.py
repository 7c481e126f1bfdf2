"""Files as a table, the gate of a rendered reel, classes of errors, and the texts of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scoring import filled

#: Bounds of a rendered reel and what the gate says.
LEAST_BYTES, LEAST_REEL, MOST_REEL = 10_000, 3, 180
NO_FILE, SMALL_FILE, NO_CAPTIONS = "render produced no file", "rendered file is suspiciously small (render likely failed)", "the reel has no captions"

#: Classes of download errors in the order in which they are asked, with the markers that tell them.
MARKERS = [
    ("bot_challenge", ["sign in to confirm you're not a bot", "sign in to confirm you’re not a bot", "confirm you're not a bot", "confirm you’re not a bot", "not a bot", "confirm you are not a bot", "sign in to confirm", "cookies-from-browser", "use --cookies", "please sign in", "login required"]),
    ("format_unavailable", ["requested format is not available", "requested format not available", "format is not available"]),
    ("blocked", ["403", "forbidden", "unable to download video data", "the page needs to be reloaded", "please try again"]),
    ("transient", ["timed out", "timeout", "connection reset"]),
]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def sized(files: DataFrame) -> DataFrame:
    """One row a path."""
    return files.where("path is not null").groupBy("path").agg(F.max("size").alias("size"))


def lacking(beats: DataFrame, files: DataFrame) -> DataFrame:
    """beats with clip_path emptied where no such file exists, so that every rule on footage sees files."""
    there = sized(files).select(F.col("path").alias("clip_path"), F.lit(True).alias("there"))
    return beats.join(there, "clip_path", "left").withColumn("clip_path", F.when(F.col("there"), F.col("clip_path")).otherwise("")).select(*beats.columns)


def reel_gate(reels: DataFrame, files: DataFrame) -> DataFrame:
    """Why a rendered reel (id, path, duration in seconds or null, n_words) isn't fit to post: its file, length or captions."""
    j = reels.join(sized(files), "path", "left")
    rounded = F.bround("duration").cast("long").cast("string")
    why = (
        F.when(~filled("path") | F.col("size").isNull(), NO_FILE)
        .when(F.col("size") < LEAST_BYTES, SMALL_FILE)
        .when(~F.col("duration").between(LEAST_REEL, MOST_REEL), F.concat(F.lit("duration "), rounded, F.lit(f"s is outside platform bounds ({LEAST_REEL}–{MOST_REEL}s)")))
        .when(F.coalesce("n_words", F.lit(0)) == 0, NO_CAPTIONS)
    )
    return j.select("id", why.alias("reason"), why.isNull().alias("passed"))


def marker_table(spark: SparkSession, markers: list[tuple[str, list[str]]] = MARKERS) -> DataFrame:
    """(place, class, marker): classes are asked in order of place."""
    return spark.createDataFrame([(k, c, m) for k, (c, ms) in enumerate(markers) for m in ms], "place int, class string, marker string")


def classified(errors: DataFrame, markers: DataFrame, text: str = "message", most: int = 2000) -> DataFrame:
    """errors with `class`, the first whose marker is in the lower-cased text, or null.

    A table of at most `most` markers becomes an expression that each row is asked once. Beyond that texts and markers meet by
    the markers' first characters, as many as the shortest marker has, and only markers that do are looked for; errors need an `id` then.
    """
    given = markers.where("marker is not null and marker <> ''")
    n, shortest = given.agg(F.count("*"), F.min(F.length("marker"))).first()
    low = F.lower(text)
    if n <= most:
        by_class: dict[tuple, list[str]] = {}
        for r in given.select("place", "class", "marker").orderBy("place").collect():  # at most `most` rows
            by_class.setdefault((r[0], r[1]), []).append(r[2])
        found = F.coalesce(F.lit(None).cast("string"), *[F.when(F.exists(F.array(*map(F.lit, ms)), lambda m: F.contains(low, m)), c) for (_, c), ms in by_class.items()])
        return errors.withColumn("class", found)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - shortest + 1, F.lit(1))), lambda k: F.substr(low, k, F.lit(shortest))))
    heads = given.select(F.substring("marker", 1, shortest).alias("head"), "place", "class", "marker")
    met = errors.select("id", low.alias("low"), F.explode(grams).alias("head")).join(heads, "head").where(F.contains("low", F.col("marker")))
    first = met.groupBy("id").agg(F.min_by("class", "place").alias("class"))
    return errors.join(first, "id", "left")


def worker_message(code: Column, reason: Column, tail: Column, native_floor: int = 0xC0000000) -> Column:
    """What a worker that ended with `code` tells the user: its own reason, a crash inside the runtime, or the last three lines of its output."""
    said = F.filter(F.slice(tail, F.greatest(F.size(tail) - 2, F.lit(1)), F.lit(3)), lambda t: t != "")
    plain = F.concat(F.lit("transcription failed (exit "), code, F.lit(")"), F.when(F.size(said) > 0, F.concat(F.lit(": "), F.array_join(said, " / "))).otherwise(""))
    crashed = F.concat(F.lit("transcription crashed inside the runtime (exit "), code, F.lit(")"))
    return F.when(F.coalesce(reason, F.lit("")) != "", reason).when((code < 0) | (code >= native_floor), crashed).otherwise(plain)


def crop_lefts(center: Column, source: int, crop: int) -> Column:
    """The left edge of a crop about a center, inside the source; rounds half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(max(0, source - crop)), F.bround(center * source - crop / 2.0))).cast("long")


def x_expression(shots: DataFrame, source: int, crop: int, key: str = "track_id") -> DataFrame:
    """key and `expr`: where a crop's left edge is over time, from shots (key, start_ms, center); shot i holds from its start on.

    The text nests from the first boundary inwards, so its openings, the last value and as many closings are three joins: no fold.
    """
    w = Window.partitionBy(key).orderBy("start_ms")
    edges = shots.withColumn("x", crop_lefts(F.col("center"), source, crop)).withColumn("next", F.lead("start_ms").over(w))
    opened = F.when(F.col("next").isNotNull(), F.format_string("if(lt(t,%.3f),%d,", F.col("next") / 1000.0, F.col("x")))
    per = edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_ms", opened.alias("o"), "x"))).alias("s"))
    return per.select(key, F.concat(F.array_join(F.transform("s", lambda e: e["o"]), ""), F.element_at("s", -1)["x"].cast("string"), F.repeat(F.lit(")"), F.size("s") - 1)).alias("expr"))


def voice_pad(voice_seconds: Column, video_seconds: Column) -> Column:
    """The filter that holds the last frame while a voice goes on, or nothing where it fits."""
    extra = voice_seconds - F.coalesce(video_seconds, F.lit(0.0))
    return F.when(extra > 0.05, F.format_string("tpad=stop_mode=clone:stop_duration=%.3f", extra)).otherwise("")


def chained(*filters: Column) -> Column:
    """Filters in order, with commas between; empty ones are left out."""
    return F.concat_ws(",", *[F.when(f != "", f) for f in filters])


def frame_rate(rate: Column) -> Column:
    """A rate like 30000/1001 as a number; 30 where it is none, or not above zero."""
    parts = F.split(F.coalesce(rate, F.lit("")), "/", 2)
    below = F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("1"))
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), below.try_cast("double"))
    return F.when(value > 0, value).otherwise(30.0)


def output_size(width: Column, ratio_w: Column, ratio_h: Column) -> Column:
    """struct(width, height) of an output, both even."""
    height = F.bround(width * ratio_h / ratio_w.cast("double")).cast("long")
    return F.struct((width - width % 2).alias("width"), (height - height % 2).alias("height"))


def object_position(center: Column, source_aspect: Column, target_aspect: float = 9 / 16) -> Column:
    """How many percent of what is cut off lie on the left, so that a preview shows what the export crops."""
    r = F.when(source_aspect > 0, F.least(F.lit(1.0), target_aspect / source_aspect)).otherwise(1.0)
    return F.when(r >= 1, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(center - r / 2, 1 - r))) * 100)


def preview_center(track_center: Column, track_base: Column, center: Column, within: float = 1e-4) -> Column:
    """Where a preview looks: where the track is, as long as nobody has moved the crop from where the track was stored; without a track the crop's own center."""
    return F.when(track_center.isNotNull() & (F.abs(center - track_base) < within), track_center).otherwise(center)


#: A caption style is big from this size on, with no more words in a line.
BIG_SIZE, BIG_WORDS = 120, 3


def big_captions(size: Column, max_words: Column) -> Column:
    """Whether a caption style is the big one, by its shape; without a style it isn't."""
    return F.coalesce((size >= BIG_SIZE) & (max_words <= BIG_WORDS), F.lit(False))


def track_covers(start: Column, end: Column, lo: Column, hi: Column, slack: int = 50) -> Column:
    """Whether a track lies over a clip, give or take 50 ms; without a track it doesn't."""
    return F.coalesce((start <= lo + slack) & (end >= hi - slack), F.lit(False))
