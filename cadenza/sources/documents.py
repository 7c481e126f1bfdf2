"""JSON documents: cached transcripts and a folder of brand configurations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "array<struct<start:double,end:double,word:string>>"
BRAND = "name string, autonomy string, feed boolean, cadence struct<reels_per_week:int,platforms:array<string>>, angle_library array<string>, hook_seeds array<string>, voice struct<banned_phrases:array<string>>, proof_rules boolean"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files, each whole; none where there is no such file."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """project_id, idx, word, start_ms, end_ms of files <project_id>/words.json, each an array of {start, end, word}.

    A missing, empty or corrupt file is as one without words.
    """
    parsed = read_whole(spark, path).select(F.regexp_extract("path", r"(\d+)/[^/]*$", 1).try_cast("long").alias("project_id"), F.from_json("text", WORDS).alias("words"))
    each = parsed.select("project_id", F.posexplode("words").alias("idx", "w")).where("w.word is not null and w.start is not null and w.end is not null")
    ms = lambda c: F.round(F.col(f"w.{c}") * 1000).cast("long")
    return each.select("project_id", F.col("idx").cast("long").alias("idx"), F.col("w.word").alias("word"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def brand_files(spark: SparkSession, folder: str) -> DataFrame:
    """The configurations of operators.lifecycle from <folder>/*.json, by file name; a broken file is skipped, and a brand without a name has its file's."""
    c = F.from_json("text", BRAND, {"mode": "PERMISSIVE"})
    files = read_whole(spark, f"{folder.rstrip('/')}/*.json").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("slug"), F.get_json_object("text", "$").alias("fine"), c.alias("c"))
    fine = files.where("fine is not null and c is not null")
    return fine.select(
        "slug", F.coalesce("c.name", "slug").alias("brand"), F.col("c.cadence.reels_per_week").alias("reels_per_week"), F.col("c.autonomy").alias("autonomy"), F.col("c.feed").alias("feed"),
        F.col("c.angle_library").alias("angles"), F.col("c.voice.banned_phrases").alias("banned"), F.col("c.proof_rules").alias("proof_rules"), F.col("c.cadence.platforms").alias("platforms"), F.col("c.hook_seeds").alias("hook_seeds"),
    ).orderBy("slug").drop("slug")


def configured(names: DataFrame, config: DataFrame) -> DataFrame:
    """Configurations for all named brands (column brand); one without a file has none set, so all defaults hold."""
    return names.select("brand").distinct().join(config, "brand", "left")
