"""Streams with keyed state against the batch operators."""

import json
import random

from pyspark.sql import functions as F

from cadenza.operators import engagement, lifecycle
from cadenza.sources.bridge import BRAND_SCHEMA, STAGES
from cadenza.streaming import angles, autopilot, perf

CONFIG = [("en", 9, "semi", True, ["angle 0", "angle 1"], [], False, []), ("fr", 2, None, False, ["x"], [], False, []), ("de", 3, "hands_off", True, ["only"], [], False, [])]
TICKET = "id long, brand string, angle string, stage string, capture_mode string, autopilot boolean, gate string, tries long, failure string"
WORK = {(t, s): f"{s} broke" for t in range(40) for s in STAGES if (t * 7 + STAGES.index(s)) % 5 == 0}


def tables(spark):
    gates = [None, None, "awaiting_footage", "awaiting_approval", "parked"]
    rows = [(k, ["en", "fr", "de"][k % 3], "a", "odd" if k == 16 else STAGES[k % 8], "native-short" if k % 4 else "repurpose", k % 6 != 5, gates[k % 5]) for k in range(40)]
    beats = [(t * 10 + j, t, bool((t + j) % 3)) for t in range(40) for j in range(t % 4)]
    return rows, beats


def applied(tickets, hops):
    """Tickets after a tick: tries belong to a stage."""
    at = {r.id: r for r in hops}
    out = []
    for id_, brand, angle, stage, mode, auto, gate, tries, _ in tickets:
        if id_ in at:
            r = at[id_]
            tries = r.tries_after if r.stage_after == stage else 0
            stage, gate = r.stage_after, r.gate_after
        out.append((id_, brand, angle, stage, mode, auto, gate, tries, WORK.get((id_, stage))))
    return out


def plain(rows):
    return sorted((r.id, r.stage, r.outcome, r.stage_after, r.gate_after, r.gate_reason, r.tries_after, r.last_error) for r in rows)


def test_two_ticks_equal_the_batch_operator_twice(spark, tmp_path):
    rows, beats = tables(spark)
    config = spark.createDataFrame(CONFIG, BRAND_SCHEMA)
    folder = str(tmp_path)
    added = spark.createDataFrame([(*r, "ticket", 0) for r in rows], "ticket_id long, brand string, angle string, stage string, capture_mode string, autopilot boolean, gate string, kind string, seq int")
    footage = spark.createDataFrame([(t, b, f, "beat", 0) for b, t, f in beats], "ticket_id long, beat_id long, filled boolean, kind string, seq int")
    results = spark.createDataFrame([(t, s, e, "result", 0) for (t, s), e in WORK.items()], "ticket_id long, stage string, error string, kind string, seq int")
    autopilot.send(added.unionByName(footage, True).unionByName(results, True), folder, "given")

    batch_beats = spark.createDataFrame([(b, t, "x" if f else "") for b, t, f in beats], "id long, ticket_id long, clip_path string")
    tickets = [(*r, 0, WORK.get((r[0], r[3]))) for r in rows]
    for tick in (1, 2):
        assert autopilot.run_tick(spark, folder, config) == tick
        fed = autopilot.fed(spark.createDataFrame(tickets, TICKET), config).collect()
        assert {(r.brand, r.angle) for r in fed} <= {("en", "angle 0"), ("en", "angle 1"), ("de", "only")}
        tickets += [(r.ticket_id, r.brand, r.angle, "outlier", "native-short", True, None, 0, None) for r in fed]
        want = lifecycle.tick_outcome(spark.createDataFrame(tickets, TICKET), batch_beats, config).collect()
        got = autopilot.history(spark, folder).where(f"tick = {tick} and outcome <> 'added'")
        assert plain(got.collect()) == plain(want)
        tickets = applied(tickets, want)
    assert len({r.outcome for r in autopilot.history(spark, folder).collect()}) >= 8


def test_a_broken_ticket_stops_no_other_and_a_seen_tick_changes_nothing(spark, tmp_path):
    config = spark.createDataFrame([("en", 1, "hands_off", False, [], [], False, [])], BRAND_SCHEMA)
    rows = spark.createDataFrame([(k, "en", "outlier", "repurpose", True, "ticket", 0) for k in range(5)], "ticket_id long, brand string, stage string, capture_mode string, autopilot boolean, kind string, seq int")
    folder = str(tmp_path)
    autopilot.send(rows, folder, "given")

    def work(ticket):
        if ticket["id"] == 3:
            raise RuntimeError("no such brand")
        return "not yet" if ticket["id"] == 4 else None

    autopilot.run_tick(spark, folder, config, work)
    now = lambda: {r.id: r.stage for r in autopilot.current(spark, folder).collect()}
    assert now() == {0: "scripted", 1: "scripted", 2: "scripted", 3: "outlier", 4: "outlier"}
    assert {r.id: r.outcome for r in autopilot.history(spark, folder).where("tick = 1").collect()} == {0: "advanced", 1: "advanced", 2: "advanced", 3: "error:no such brand", 4: "retry"}
    autopilot.send(spark.createDataFrame([(k, "tick", 1, 1) for k in range(5)], "ticket_id long, kind string, tick long, seq int"), folder, "tick-1-again")
    autopilot.advance(spark, folder, work)
    assert now() == {0: "scripted", 1: "scripted", 2: "scripted", 3: "outlier", 4: "outlier"}
    autopilot.run_tick(spark, folder, config, work)
    autopilot.run_tick(spark, folder, config, work)
    assert now() == {0: "sourced", 1: "sourced", 2: "sourced", 3: "outlier", 4: "outlier"}
    last = {r.id: (r.gate, r.gate_reason) for r in autopilot.current(spark, folder).collect()}
    assert last[4] == ("parked", "not yet") and last[3] == (None, None)
    autopilot.send(spark.createDataFrame([(4, "switch", False, 9), (0, "switch", False, 9), (0, "switch", True, 10)], "ticket_id long, kind string, autopilot boolean, seq int"), folder, "people")
    autopilot.advance(spark, folder, work)
    assert {r.id: (r.autopilot, r.gate) for r in autopilot.current(spark, folder).where("id in (0, 4)").collect()} == {0: (True, None), 4: (False, None)}


def test_angles_follow_late_repeated_and_older_facts(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        reel = rng.random() < 0.6
        vid = rng.randrange(12)
        rows.append({"id": k, "ticket_id": rng.choice([vid, None, rng.randrange(12)]), "video_kind": "reel" if reel else "clip", "video_id": vid, "platform": rng.choice(["tt", "yt"]), "views": rng.randrange(3000), "follows": rng.randrange(3), "saves": 1, "sends": 0, "captured_at": f"2024-01-{rng.randrange(1, 28):02d}T{rng.randrange(24):02d}:00:00Z"})
    rows += rng.sample(rows, 40)  # told again
    tickets = spark.createDataFrame([(k, f"angle {k % 4}") for k in range(14)], "id long, angle string")
    (tmp_path / "in").mkdir()
    seen = []
    for part in range(3):
        now = rows[part::3]
        seen += now
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, now)))
        angles.start(perf.facts(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
        log = spark.read.schema(perf.PERF).json(spark.sparkContext.parallelize(list(map(json.dumps, seen))))
        best = engagement.keyed(log).groupBy("kind", "vid", "platform").agg(F.max_by(F.struct("ticket_id", "views", "follows", "saves", "sends"), F.struct("captured_at", "id")).alias("r")).select("r.*")
        want = sorted(map(tuple, engagement.angle_rollup(best, tickets).collect()))
        assert sorted(map(tuple, angles.rollup(spark, str(tmp_path / "log"), tickets).collect())) == want
    assert any(score > 0 for _, _, score in want)
