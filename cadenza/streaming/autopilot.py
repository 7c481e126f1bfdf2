"""The autopilot as a stream: tickets are keyed state, and a tick moves each of them by one hop.

Events land as JSON files and are kept by ticket: a value state holds where the ticket is, one map state which of its beats
have footage, another how the work of each stage went and how often it failed. `run_tick` feeds first (brands below their
target get a ticket with the angle that is next) and then sends every ticket on autopilot a numbered tick. A tick that a
ticket has seen is ignored, so events that are written twice after a failure change nothing. What goes wrong
with a ticket is its row's outcome and leaves its state as it was; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.lifecycle import GATE_REASONS, GATED, MAX_TRIES, feed_plan, settled
from cadenza.sources.bridge import STAGES
from cadenza.streaming.state import started, to_log

#: kind is ticket, beat, result, approve, switch or tick; seq orders a ticket's events of one batch.
EVENT = "ticket_id long, seq long, kind string, tick long, brand string, angle string, stage string, capture_mode string, level string, gate string, autopilot boolean, beat_id long, filled boolean, error string"
HOP = "id long, seq long, tick long, brand string, angle string, capture_mode string, autopilot boolean, stage string, outcome string, stage_after string, gate_after string, gate_reason string, tries_after int, last_error string"
TICKET = "brand string, angle string, stage string, capture_mode string, autopilot boolean, gate string, gate_reason string, tick long"
BEAT_KEY, BEAT = "beat_id long", "filled boolean"
WORK_KEY, WORK = "stage string", "tries int, error string"
Work = Callable[[dict], str | None]


def hop(ticket: dict, level: str | None, missing: int, tries: int, failure: str | None) -> dict:
    """What a tick makes of a ticket: the rules of operators.lifecycle.tick_outcome for one row."""
    stage, gate = ticket["stage"], ticket["gate"]
    lacking = missing > 0 and ticket["capture_mode"] == "native-short"
    after = {"outcome": "waiting", "stage": stage, "gate": gate, "reason": None, "tries": tries, "error": None}
    if (gate == "awaiting_footage" and lacking) or gate in ("awaiting_approval", "parked"):
        return after
    after["gate"] = None
    if stage == "posted":
        return after | {"outcome": "done", "gate": "done"}
    if stage not in STAGES:
        return after | {"outcome": "noop"}
    if stage == "staged":
        if lacking:
            return after | {"outcome": "footage", "gate": "awaiting_footage", "reason": f"{missing} scene(s) still need footage"}
    elif failure is not None and stage != "scripted":
        parked = tries + 1 > MAX_TRIES
        return after | {"outcome": "parked" if parked else "retry", "gate": "parked" if parked else None, "reason": failure if parked else None, "tries": tries + 1, "error": failure[:400]}
    entered = STAGES[STAGES.index(stage) + 1]
    if entered in GATED.get(level, GATED["supervised"]):
        return after | {"outcome": "gated", "stage": entered, "gate": "awaiting_approval", "reason": GATE_REASONS.get(entered, "review")}
    return after | {"outcome": "advanced", "stage": entered}


class Tickets(StatefulProcessor):
    """`work` does a stage's work for a ticket and returns why it failed, or None; without it the last result event of the stage counts."""

    def __init__(self, work: Work | None = None):
        self.work = work

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticket = handle.getValueState("ticket", TICKET)
        self.beats = handle.getMapState("beats", BEAT_KEY, BEAT)
        self.results = handle.getMapState("results", WORK_KEY, WORK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # of events with one seq, the tick comes last
        for e in sorted(rows, key=lambda e: (e.seq or 0, e.kind == "tick")):
            if e.kind == "beat":
                self.beats.updateValue((e.beat_id,), (bool(e.filled),))
            elif e.kind == "result":
                self.results.updateValue((e.stage,), (self.tries(e.stage), e.error))
            elif e.kind == "ticket" and not self.ticket.exists():
                yield self.told(key[0], e, self.changed(brand=e.brand, angle=e.angle, stage=e.stage, capture_mode=e.capture_mode, autopilot=bool(e.autopilot), gate=e.gate, gate_reason=None, tick=-1), "added")
            elif self.ticket.exists():
                yield from self.moved(key[0], e)

    def moved(self, id_: int, e: Row) -> Iterator[Row]:
        t = self.held()
        if e.kind == "approve" and t["gate"] in ("awaiting_approval", "awaiting_footage"):
            yield self.told(id_, e, self.changed(gate=None, gate_reason=None), "approved")
        elif e.kind == "switch":
            off = {} if e.autopilot else {"gate": None, "gate_reason": None}
            yield self.told(id_, e, self.changed(autopilot=bool(e.autopilot), **off), "switched")
        elif e.kind == "tick" and t["autopilot"] and e.tick > t["tick"]:
            try:
                missing = sum(not filled[0] for _, filled in self.beats.iterator())
                waits = t["gate"] in ("awaiting_approval", "parked")
                failure = None if waits else self.failure(id_, t)
                after = hop(t, e.level, missing, self.tries(t["stage"]), failure)
            except Exception as error:  # one ticket's failure is told in its row, and the others go on
                self.changed(tick=e.tick)
                yield self.told(id_, e, t, f"error:{error}"[:400], t)
                return
            if after["outcome"] in ("retry", "parked"):
                self.results.updateValue((t["stage"],), (after["tries"], after["error"]))
            now = self.changed(stage=after["stage"], gate=after["gate"], gate_reason=after["reason"], tick=e.tick)
            yield self.told(id_, e, now, after["outcome"], t, after)

    def failure(self, id_: int, t: dict) -> str | None:
        if self.work:
            return self.work({"id": id_, **t})
        found = self.results.getValue((t["stage"],)) if self.results.containsKey((t["stage"],)) else None
        return found[1] if found else None

    def tries(self, stage: str) -> int:
        return self.results.getValue((stage,))[0] if self.results.containsKey((stage,)) else 0

    def held(self) -> dict:
        names = [c.split()[0] for c in TICKET.split(", ")]
        return dict(zip(names, self.ticket.get(), strict=True)) if self.ticket.exists() else dict.fromkeys(names)

    def changed(self, **to) -> dict:
        t = self.held() | to
        self.ticket.update(tuple(t.values()))
        return t

    def told(self, id_: int, e: Row, t: dict, outcome: str, before: dict | None = None, after: dict | None = None) -> Row:
        tries, error = (after["tries"], after["error"]) if after else (self.tries(t["stage"]), None)
        return Row(
            id=id_, seq=e.seq, tick=e.tick, brand=t["brand"], angle=t["angle"], capture_mode=t["capture_mode"], autopilot=t["autopilot"], stage=(before or t)["stage"],
            outcome=outcome, stage_after=t["stage"], gate_after=t["gate"], gate_reason=after["reason"] if after else t["gate_reason"], tries_after=tries, last_error=error,
        )

    def close(self) -> None:
        pass


def hops(events: DataFrame, work: Work | None = None) -> DataFrame:
    """A row of HOP for each event that changes a ticket."""
    return events.groupBy("ticket_id").transformWithState(Tickets(work), HOP, "append", "none")


def send(events: DataFrame, folder: str, name: str) -> None:
    """Adds events (any columns of EVENT) to the stream; the same name again replaces what hasn't been read."""
    given = [F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t) for c, t in (f.split() for f in EVENT.split(", "))]
    events.select(*[g.alias(f.split()[0]) for g, f in zip(given, EVENT.split(", "), strict=True)]).write.mode("overwrite").json(f"{folder.rstrip('/')}/events/{name}")


def advance(spark: SparkSession, folder: str, work: Work | None = None) -> None:
    """Runs the stream over the events that it hasn't seen."""
    events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(f"{folder.rstrip('/')}/events")
    started(hops(events, work), to_log(f"{folder}/log"), f"{folder}/checkpoint").awaitTermination()


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of HOP so far with their batch."""
    try:
        return spark.read.schema(HOP + ", batch long").parquet(f"{folder.rstrip('/')}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HOP + ", batch long")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Each ticket as it is now."""
    last = history(spark, folder).groupBy("id").agg(F.max_by(F.struct("brand", "angle", "capture_mode", "autopilot", F.col("stage_after").alias("stage"), F.col("gate_after").alias("gate"), "gate_reason"), F.struct("batch", "seq", F.coalesce("tick", F.lit(-1)))).alias("t"))
    return last.select("id", "t.*")


def fed(tickets: DataFrame, config: DataFrame) -> DataFrame:
    """Events that add a ticket for each brand that feed_plan names; ids follow the largest."""
    top = tickets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    plan = feed_plan(tickets, config)
    # one row beside a row a brand
    number = F.row_number().over(Window.orderBy("brand"))
    return plan.crossJoin(F.broadcast(top)).select((F.col("top") + number).alias("ticket_id"), "brand", "angle", F.lit("outlier").alias("stage"), F.lit("native-short").alias("capture_mode"), F.lit(True).alias("autopilot"), F.lit("ticket").alias("kind"))


def run_tick(spark: SparkSession, folder: str, config: DataFrame, work: Work | None = None) -> int:
    """One cycle: feed, then a hop of every ticket on autopilot, fed ones included. Returns the tick's number."""
    advance(spark, folder, work)  # what came in since
    number = (history(spark, folder).agg(F.max("tick")).first()[0] or 0) + 1
    tickets = current(spark, folder)
    new = fed(tickets, config)
    live = tickets.where("autopilot").select(F.col("id").alias("ticket_id"), "brand").unionByName(new.select("ticket_id", "brand"))
    ticks = live.join(settled(config).select("brand", "level"), "brand", "left").select("ticket_id", "level", F.lit("tick").alias("kind"))
    send(new.unionByName(ticks, allowMissingColumns=True).withColumns({"tick": F.lit(number), "seq": F.lit(number)}), folder, f"tick-{number}")
    advance(spark, folder, work)
    return number
