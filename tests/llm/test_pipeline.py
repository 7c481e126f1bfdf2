"""The pipeline's stages, each against a brute-force version on what the stage before kept."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import packing, quality, queries

from . import cases
from .test_copies import lines_by_force, repeats_by_force, simhash_by_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, cases.SF, "documents")
    found = [[tuple(r) for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, cases.SF))
        found.append([tuple(r) for r in docs.collect()])
        if len(found) < 6:
            assert docs.columns == COLUMNS
    return found


def test_quality_stage(spark, stages):
    docs = queries.table(spark, cases.SF, "documents")
    good = {r.doc_id for r in quality.scored(docs, quality.fit(docs, queries.table(spark, cases.SF, "labels"))).where("score >= 0.7").collect()}
    assert 0 < len(stages[1]) < len(stages[0])
    assert Counter(stages[1]) == Counter(r for r in stages[0] if r[0] in good)


def test_line_stage(stages):
    gone = lines_by_force([r[:2] for r in stages[1]])
    want = Counter()
    for i, t, *more in stages[1]:
        g = gone.get((i, t or ""))
        want[(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) if g else t, *more)] += 1
    assert Counter(stages[2]) == want


def test_simhash_stage(stages):
    found = simhash_by_force([r[:2] for r in stages[2]])
    stay = {i for i, _, c in found if i == c}
    assert Counter(stages[3]) == Counter(r for r in stages[2] if r[0] in stay)


def test_substring_stage(stages):
    want = repeats_by_force([r[:2] for r in stages[3]], 50)
    assert Counter((r[0], sha(b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())))) for r in stages[4]) == Counter((w[0], w[3]) for w in want.elements())


def test_packing_stage(spark, stages):
    docs = spark.createDataFrame(stages[4], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = packing.pieces_of(docs, queries.tokenizer_file(queries.WORD_MODEL))
    assert Counter(r[:5] for r in stages[5]) == Counter(map(tuple, pieces.collect()))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, cases.SF)
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(r[:5] for r in stages[5])


def test_run_over_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and columns of clashing names pass through all stages; so does an empty table."""
    odd = cases.odd(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")))
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(cases.TEXTS) if i] + [(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs, told in (("odd", odd, labels), ("none", cases.empty(spark), labels.limit(0)), ("unlabelled", odd, labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        told.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        seen = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in pieces}
        assert len(seen) == len(pieces) and all(0 < r.length <= 4096 and r.offset + r.length <= 4096 for r in pieces)
        assert {r.doc_id for r in pieces} <= {i for i, _ in cases.TEXTS} and (name != "none" or not pieces)
