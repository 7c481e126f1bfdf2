"""Takes that land in a folder, and the tries of each ticket's stages, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.lifecycle import MAX_TRIES

#: The endings of recorded takes.
ENDINGS = ["mp4", "mov", "m4v", "webm", "mkv", "avi"]


def takes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, mtime, size) of takes that land in a folder, each once; contents aren't read. A file is written elsewhere
    and moved there when it is whole, so its size needs no second look; empty ones are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where((F.col("length") > 0) & ending.isin(ENDINGS)).select("path", name.alias("filename"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def land(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is an upload: its takes are written with its number and their place in it, by time and name."""

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("batch_id").orderBy("mtime", "path")
        numbered = batch.withColumn("batch_id", F.lit(number)).withColumn("place", F.row_number().over(w) - 1)
        numbered.withColumn("status", F.lit("uploaded")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/upload={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tries(results: DataFrame) -> DataFrame:
    """Of a stream of (ticket_id, stage, at, error), error null where the work went well: after each result the failures of the
    ticket's stage so far, the last error and whether the ticket is parked. Success starts the count anew."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(frames)).sort_values("at")
        for at, error in zip(rows["at"], rows["error"], strict=True):
            failed = isinstance(error, str)
            n = n + 1 if failed else 0
            out.append((key[0], key[1], at, n, error[:400] if failed else None, n > MAX_TRIES))
        state.update((n,))
        yield pd.DataFrame(out, columns=["ticket_id", "stage", "at", "tries", "last_error", "parked"])

    schema = "ticket_id long, stage string, at timestamp, tries int, last_error string, parked boolean"
    return results.groupBy("ticket_id", "stage").applyInPandasWithState(count, schema, "tries int", "append", GroupStateTimeout.NoTimeout)
