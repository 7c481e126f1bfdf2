"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import archives, collocations, language, line_dedup, merkle, quality
from cadenza.llm.neighbours import search
from cadenza.llm.packing import pack
from cadenza.llm.piece_encode import encode_documents
from cadenza.llm.simhash import near_duplicates
from cadenza.llm.substrings import drop_repeats
from cadenza.llm.token_count import count_tokens
from cadenza.llm.vector_dedup import near_vectors

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A tokenizer's file, read on the driver and sent to the executors (a fixed file of a few MB)."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_MODEL))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.deduplicated_pages(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"), merkle.lowered_third())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_encode": op1_piece_encode,
    "op2_neighbours": op2_neighbours,
    "op3_token_count": op3_token_count,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_substrings": op8_substrings,
    "op9_language": op9_language,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_warc": archives.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
