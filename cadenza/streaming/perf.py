"""The perf facts as a stream: the last row of each video and platform wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.functions.scoring import COUNTERS, perf_score
from cadenza.operators.engagement import keyed, latest
from cadenza.sources import outbox

PERF = "id long, ticket_id long, video_kind string, video_id long, platform string, views long, follows long, saves long, sends long, captured_at timestamp"
#: The fields of a sheet's row.
ROW_FIELDS = ["post_id", "date", "brand", "platform", "journey_stage", "hook", "hook_trigger", "angle", "caption_style", "views", "follows", "saves", "sends"]


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Fact rows from JSON files that land in a folder; a file is written elsewhere and moved there."""
    return spark.readStream.schema(PERF).json(folder)


def upserts(stream: DataFrame) -> DataFrame:
    """The rows that change, in update mode: state holds one row for each video and platform, not the stream."""
    return latest(stream)


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Sums and score of each capture day; rows later than `late` are left out. An addition: batch has no such limit."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    days = stream.withWatermark("captured_at", late).groupBy(F.window("captured_at", "1 day").alias("w")).agg(*sums)
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *COUNTERS, perf_score().alias("score"))


def start_upserts(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed rows to <log>/batch=<id>; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={number}")

    return upserts(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """The table that the changes add up to."""
    rows = spark.read.parquet(log)
    w = Window.partitionBy("kind", "vid", "platform").orderBy(F.desc("batch"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "batch")


def sheet_rows(perf: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows of ROW_FIELDS as JSON, in order of capture; videos has kind, vid, brand, hook, angle, caption_style."""
    name = F.create_map(*[F.lit(x) for p in (("tt", "TikTok"), ("ig", "Instagram"), ("yt", "YouTube")) for x in p])
    j = keyed(perf).join(videos, ["kind", "vid"], "left")
    values = {"post_id": F.concat_ws("-", "kind", F.col("vid").cast("string"), "platform"), "date": F.date_format("captured_at", "yyyy-MM-dd"), "platform": F.coalesce(name[F.col("platform")], F.col("platform"))}
    text = lambda c: values.get(c, F.coalesce(F.col(c), F.lit("")) if c in ("brand", "hook", "angle", "caption_style") else F.lit(""))
    row = F.struct(*[(F.col(c) if c in COUNTERS else text(c)).alias(c) for c in ROW_FIELDS])
    return j.select("captured_at", "id", F.to_json(row).alias("value")).orderBy("captured_at", "id").select("value")


def push_rows(rows: DataFrame, target: str | None, batch: str, staging: str | None = None) -> dict:
    """Sends the rows once under the batch's name, or nothing where no target is set; a failure is reported, not raised."""
    return outbox.push(rows, batch, target, staging)


def start_pushes(stream: DataFrame, videos: DataFrame, target: str | None, staging: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of facts goes to the sheet as one batch; one that is run again doubles no row."""

    def write(batch: DataFrame, number: int) -> None:
        push_rows(sheet_rows(batch, videos), target, f"facts-{number}", staging)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
