"""What the training-data operators share: shared storage, bounded caches, batches and splits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.storage import checkpointed, shared_dir, stored

__all__ = ["Memo", "checkpointed", "held_out", "id_and_text", "shared_dir", "small_batches", "stored"]


class Memo(dict):
    """A bounded cache of a pure function: it is emptied when `limit` entries are held; long keys aren't kept."""

    def __init__(self, make, limit: int = 400_000, longest: int = 48):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most `rows` rows at a time to Python: for texts, of which the usual number is much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
