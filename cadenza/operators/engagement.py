"""Engagement analytics over the perf fact table: keys, totals, rankings and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scoring import COUNTERS, filled, first_text, perf_score, stripped, thousandths

KNOWN = ["tt", "ig", "yt"]


def sums() -> list:
    return [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in COUNTERS]


def keyed(perf: DataFrame) -> DataFrame:
    """Adds kind and vid: a row without kind or video id is a reel of its ticket; rows without any id go."""
    kind, vid = F.coalesce("video_kind", F.lit("reel")), F.coalesce("video_id", "ticket_id")
    return perf.withColumns({"kind": kind, "vid": vid}).where("vid is not null")


def latest(log: DataFrame) -> DataFrame:
    """Upsert: of each (kind, vid, platform) the row captured last, ties to the larger id; aggregated before the shuffle."""
    cols = [c for c in log.columns if c not in ("kind", "vid", "platform")]
    best = keyed(log).groupBy("kind", "vid", "platform").agg(F.max_by(F.struct(*cols), F.struct("captured_at", "id")).alias("r"))
    return best.select("kind", "vid", "platform", "r.id", *[f"r.{c}" for c in COUNTERS], "r.captured_at")


def kpis(perf: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row: videos with numbers (or all tickets if none has), posted tickets and the sums of all rows, those without any id too."""
    kind, vid = F.coalesce("video_kind", F.lit("reel")), F.coalesce("video_id", "ticket_id")
    facts = perf.agg(F.count_distinct(F.when(vid.isNotNull(), F.struct(kind, vid))).alias("videos"), *sums())
    own = tickets.agg(F.count("*").alias("all_tickets"), F.count_if(F.col("stage") == "posted").alias("posted"))
    # two one-row tables: the broadcast is of one row
    return facts.crossJoin(F.broadcast(own)).select(F.when(F.col("videos") > 0, F.col("videos")).otherwise(F.col("all_tickets")).alias("tickets"), "posted", *COUNTERS)


def top_videos(perf: DataFrame, n: int = 8) -> DataFrame:
    """The n videos with the largest score over all platforms; ties to the one seen first."""
    per = keyed(perf).groupBy("kind", "vid").agg(*sums(), F.min("id").alias("first_id"))
    scored = per.withColumn("score", perf_score())
    return scored.orderBy(F.desc("score"), "first_id").limit(n).select("kind", "vid", "score")


def by_platform(perf: DataFrame) -> DataFrame:
    """Sums, rows and score of each platform; a blank one is '?'."""
    platform = F.when(F.coalesce("platform", F.lit("")) == "", "?").otherwise(F.col("platform")).alias("platform")
    return perf.groupBy(platform).agg(*sums(), F.count("*").alias("posts")).withColumn("score", perf_score()).orderBy(F.desc("score"), "platform")


def trend(perf: DataFrame) -> DataFrame:
    """Sums and score of each capture date; '?' where it is missing."""
    day = F.coalesce(F.date_format("captured_at", "yyyy-MM-dd"), F.lit("?")).alias("day")
    return perf.groupBy(day).agg(*sums()).withColumn("score", perf_score()).orderBy("day")


def video_pivot(perf: DataFrame, videos: DataFrame) -> DataFrame:
    """Each video with the sums of the known platforms beside their totals; videos without numbers stay."""
    facts = keyed(perf).where(F.col("platform").isin(KNOWN))
    wide = facts.groupBy("kind", "vid").pivot("platform", KNOWN).agg(*sums())
    joined = videos.join(wide, ["kind", "vid"], "left")
    parts = {f"{p}_{c}": F.coalesce(F.col(f"{p}_{c}"), F.lit(0)) for p in KNOWN for c in COUNTERS}
    joined = joined.withColumns(parts)
    totals = {c: sum((F.col(f"{p}_{c}") for p in KNOWN), F.lit(0)).cast("long") for c in COUNTERS}
    out = joined.withColumns(totals).withColumn("score", perf_score())
    return out.select("kind", "vid", "is_reel", *parts, *COUNTERS, "score").orderBy(F.desc("score"), F.desc("is_reel"), F.col("kind") == "reel", "vid")


def universe(clips: DataFrame, tickets: DataFrame, projects: DataFrame) -> DataFrame:
    """Videos that can have numbers: rendered clips or clips with markers, and tickets that were given a clip; a clip
    with markers or of a caption project is a reel."""
    modes = projects.select(F.col("id").alias("project_id"), "mode")
    tracked = clips.where((F.col("status") == "rendered") | filled("markers")).join(modes, "project_id", "left")
    reel = filled("markers") | (F.coalesce("mode", F.lit("")) == "caption")
    a = tracked.select(F.lit("clip").alias("kind"), F.col("id").alias("vid"), reel.alias("is_reel"))
    return a.unionByName(tickets.where("clip_url is not null").select(F.lit("reel").alias("kind"), F.col("id").alias("vid"), F.lit(True).alias("is_reel")))


def angle_rollup(perf: DataFrame, tickets: DataFrame) -> DataFrame:
    """Of each angle the tickets with numbers and the mean row score to two places; zero without rows."""
    rows = perf.where("ticket_id is not null").select("ticket_id", thousandths().alias("milli"))
    per = rows.groupBy("ticket_id").agg(F.sum("milli").alias("milli"), F.count("*").alias("n"))
    j = tickets.select("id", "angle").join(per, F.col("id") == F.col("ticket_id"), "left")
    out = j.groupBy("angle").agg(F.count("ticket_id").alias("posts_count"), F.sum("milli").alias("m"), F.sum("n").alias("n"))
    return out.select("angle", "posts_count", F.coalesce(F.bround(F.col("m") / F.col("n") / 1000.0, 2), F.lit(0.0)).alias("avg_score"))


def winning_patterns(perf: DataFrame, clips: DataFrame, tickets: DataFrame, k: int = 5, min_views: int = 0, brand: str | None = None) -> DataFrame:
    """The k hooks, angles and presets with the largest sum of saves and follows, of one brand or of all; ties to the one seen first."""
    facts = keyed(perf).where(F.coalesce("views", F.lit(0)) >= min_views).select("kind", "vid", (F.coalesce("saves", F.lit(0)) + F.coalesce("follows", F.lit(0))).alias("gain"), "id").where("gain > 0")
    wanted = (brand or "").strip().lower()
    own = F.lower(stripped(F.coalesce("brand", F.lit("")))) == wanted if wanted else F.lit(True)
    pair = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    hook = stripped(F.coalesce(first_text(F.col("hook"), F.col("title")), F.lit("")))
    of_clips = clips.where(own).select(F.lit("clip").alias("kind"), F.col("id").alias("vid"), F.array(pair("hook", hook), pair("preset", F.col("preset"))).alias("p"))
    of_reels = tickets.where(own).select(F.lit("reel").alias("kind"), F.col("id").alias("vid"), F.array(pair("hook", stripped(F.col("hook_text"))), pair("angle", stripped(F.col("angle")))).alias("p"))
    j = facts.join(of_clips.unionByName(of_reels), ["kind", "vid"]).select("gain", "id", F.inline("p")).where("value is not null and value <> ''")
    summed = j.groupBy("dimension", "value").agg(F.sum("gain").alias("gain"), F.min("id").alias("first_id"))
    w = Window.partitionBy("dimension").orderBy(F.desc("gain"), "first_id")
    return summed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("dimension", "place", "value", "gain")


def export_rows(perf: DataFrame) -> DataFrame:
    """All facts by capture time, as a sheet's rows."""
    name = F.create_map(*[F.lit(x) for p in (("tt", "TikTok"), ("ig", "Instagram"), ("yt", "YouTube")) for x in p])
    out = keyed(perf).select("id", "kind", "vid", F.coalesce(name[F.col("platform")], F.col("platform")).alias("platform"), F.date_format("captured_at", "yyyy-MM-dd").alias("day"), *COUNTERS, perf_score().alias("score"), "captured_at")
    return out.orderBy("captured_at", "id").drop("captured_at")
