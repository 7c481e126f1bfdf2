"""Moments are found where a project's words lie: only texts are shuffled, nothing is stored."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza import storage
from cadenza.operators import finders, transcript
from cadenza.plans import registry
from cadenza.sources import bridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["normalise_moments", "find_moments"])
def test_only_texts_are_shuffled(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(transcript, "stored", lambda df, what: made.append(what) or storage.stored(df, what))
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and not made


def transcripts(spark):
    """Projects with and without marks, one too short for a candidate, one with falling times and one long enough for chunks."""
    rng = random.Random(3)
    rows = []
    for p, n in ((1, 400), (2, 400), (3, 5), (4, 300), (5, 4000)):
        for k in range(n):
            word = rng.choice(["you", "never", "seven", "but", "money", "word", "Why", "-x"]) + ("" if p == 2 else rng.choice(["", "", "", ".", "?"]))
            at = k * 400 + rng.choice([0, 0, 0, 0, 700]) - (rng.randrange(3000) if p == 4 else 0)
            rows.append((p, k, word, max(at, 0), max(at, 0) + rng.randrange(100, 400)))
    return spark.createDataFrame(rows, "project_id long, idx long, word string, start_ms long, end_ms long").repartition(4, "project_id").localCheckpoint()


def test_candidates_at_boundaries_as_step_by_step(spark):
    words = transcripts(spark)
    sents = transcript.sentences(words)
    scored = transcript.features(sents, transcript.candidates(sents))
    want = transcript.normalised(scored.select("project_id", "start_ms", "end_ms", "quality", "i", "j"), words)
    got = transcript.normalised_candidates(words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("project_id = 5").count() > 100
    # candidates by all pairs of sentences
    a, b = sents.select("project_id", F.col("sid").alias("i"), "start_ms"), sents.select("project_id", F.col("sid").alias("j"), "end_ms")
    pairs = a.join(b, "project_id").where("j >= i and end_ms - start_ms between 15000 and 60000").collect()
    best = {min((abs(r.end_ms - r.start_ms - t), r.j, r.end_ms) for r in pairs if (r.project_id, r.i) == k)[1:] + k for k in {(r.project_id, r.i) for r in pairs if r.project_id != 5} for t in transcript.TARGETS}
    assert {(r.j, r.end_ms, r.project_id, r.i) for r in scored.where("project_id not in (3, 5)").collect()} == best


def test_moments_as_step_by_step(spark):
    pieces = transcripts(spark)
    words = transcript.chunked(transcript.merge_pieces(pieces)).withColumn("project_id", F.struct("project_id", "chunk_start")).drop("chunk_start")
    sents = transcript.sentences(words)
    best = transcript.pick_moments(transcript.features(sents, transcript.candidates(sents))).withColumn("score", F.bround(55 + 40 * F.col("quality"), 1))
    said = best.join(sents.select("project_id", F.col("sid").alias("i"), "text"), ["project_id", "i"])
    own = transcript.dedupe_moments(transcript.normalised(said.select("project_id", "start_ms", "end_ms", "score", "reason", F.substring("text", 1, 200).alias("hook")), words), "score")
    want = transcript.dedupe_moments(own.withColumn("project_id", F.col("project_id.project_id")), "score")
    cols = ["project_id", "start_ms", "end_ms", "score", "reason", "hook"]
    got = transcript.find_moments(pieces).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(cols).collect())) and len({r.project_id for r in got}) >= 4


def test_finders_leave_words_where_they_lie(spark, monkeypatch):
    """Of what a finder is asked about only the projects left are dealt out, also where they are too many to send to each task."""
    plans = []
    monkeypatch.setattr(finders, "stored", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.stored(df, what))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        finders.find(bridge.words(spark, SF), ["heuristic"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = plans[1]
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "repeat(uuid(), 30) AS text").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    t = spark.read.parquet(f"{tmp_path}/t.parquet")
    few = bridge.dealt(t, "id").rdd.getNumPartitions()
    monkeypatch.setattr(bridge, "PART_BYTES", 1_000)
    many = bridge.dealt(t, "id")
    assert many.rdd.getNumPartitions() > 30 > few and many.count() == 1000
