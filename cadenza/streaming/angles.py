"""Angle scores that follow the facts: a fact that replaces another takes the old one's share out and puts its own in.

State is keyed by video and platform and holds the row that counts there. A later row gives two changes, one that takes the old
row from its ticket and one that adds the new; an older or repeated row gives none. The changes of a ticket add up to its sums,
so the scores are a sum over changes and tickets, never over all facts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cadenza.functions.scoring import thousandths
from cadenza.operators.engagement import keyed
from cadenza.streaming.state import started, to_log

CHANGE = "ticket_id long, milli long, n long"
HELD = "at long, id long, ticket_id long, milli long"


class LastFact(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fact = handle.getValueState("fact", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = max(rows, key=lambda r: (r.at, r.id))
        old = self.fact.get() if self.fact.exists() else None
        if old and (old[0], old[1]) >= (last.at, last.id):
            return
        self.fact.update((last.at, last.id, last.ticket_id, last.milli))
        if old and old[2] is not None:
            yield Row(ticket_id=old[2], milli=-old[3], n=-1)
        if last.ticket_id is not None:
            yield Row(ticket_id=last.ticket_id, milli=last.milli, n=1)

    def close(self) -> None:
        pass


def changes(facts: DataFrame) -> DataFrame:
    """A stream of CHANGE from a stream of facts; a fact without id or time can't replace another and is left out."""
    rows = keyed(facts).where("id is not null and captured_at is not null").select("kind", "vid", "platform", F.unix_micros("captured_at").alias("at"), "id", "ticket_id", thousandths().alias("milli"))
    return rows.groupBy("kind", "vid", "platform").transformWithState(LastFact(), CHANGE, "append", "none")


def start(facts: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changes, summed by ticket, to <log>/batch=<number>."""
    write = to_log(log)

    def summed(batch: DataFrame, number: int) -> None:
        write(batch.groupBy("ticket_id").agg(F.sum("milli").alias("milli"), F.sum("n").alias("n")), number)

    return started(changes(facts), summed, checkpoint)


def rollup(spark: SparkSession, log: str, tickets: DataFrame) -> DataFrame:
    """angle, posts_count and avg_score as operators.engagement.angle_rollup gives them for the facts that count."""
    per = spark.read.parquet(log).groupBy("ticket_id").agg(F.sum("milli").alias("milli"), F.sum("n").alias("n")).where("n > 0")
    j = tickets.select("id", "angle").join(per, F.col("id") == F.col("ticket_id"), "left")
    out = j.groupBy("angle").agg(F.count("ticket_id").alias("posts_count"), F.sum("milli").alias("m"), F.sum("n").alias("n"))
    return out.select("angle", "posts_count", F.coalesce(F.bround(F.col("m") / F.col("n") / 1000.0, 2), F.lit(0.0)).alias("avg_score"))
