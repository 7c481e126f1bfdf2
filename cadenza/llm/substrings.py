"""Operator 8: repeated passages removed by difference-cover anchors.

A window is `window` consecutive words. A set of residues modulo a period whose differences hit every residue
(a difference cover, here {1, 5, 11, 24, 25, 27} modulo 31) has for any two positions a shift below the period
that brings both to cover positions. So two equal windows of 50 words hold an equal run of 50 - 31 + 1 = 20
words that begins at a cover position in both documents. Only these anchors, a fifth of all positions,
are hashed for all documents. An anchor that documents of different ids share extends to the windows that
hold it; only these windows are hashed, and grouped by hash to find the smallest doc_id in which each starts.
A word covered by a window that starts in a document with a smaller doc_id goes.

Exact copies of a text take no part: only the smallest doc_id of a text does, and a copy's windows all start in it.
Sums go before the shuffles, joins may split a hot anchor, and no pairs of documents are made.

Hashes are XXH64 of the words joined by one space with their number fixed. Null text: none; no words, nothing
removed. A null doc_id neither gives nor loses words. Repeated rows are each returned with the same result.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import id_and_text, stored

COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space, and where each begins and ends there."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def hashes(words: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    """XXH64 of the `width` words from each position."""
    from xxhash import xxh64_intdigest

    joined, starts, ends = word_spans(words)
    spans = zip(starts[at].tolist(), ends[at + width - 1].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in spans), np.uint64, len(at)).view(np.int64)


def cover_positions(n_words: int, width: int) -> np.ndarray:
    at = np.arange(max(0, n_words - width + 1))
    return at[np.isin(at % PERIOD, COVER)]


def listed(run: Callable, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """For each row (id, text, ...) the rows that run(words, the row's further values) gives as arrays, after the id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            further = zip(*(part.column(k).to_pylist() for k in range(2, part.num_columns)), strict=True) if part.num_columns > 2 else [()] * part.num_rows
            found = [run(text.split(), *x) for text, x in zip(part.column(1).cast(pa.binary()).to_pylist(), further, strict=True)]
            pick = pa.array(np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pick), *columns], names)


NONE = np.zeros(0, np.int64)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, keys ...) with the text replaced by n_words and the digest of all words."""
    for batch in batches:
        words = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        columns = [batch.column(0), *batch.columns[2:], pa.array(list(map(len, words)), pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *batch.schema.names[2:], "n_words", "all_sha256"])


KEYS = ["h1", "h2", "n_bytes"]  # equal for equal texts only, but for a chance below 2 to the -96 for any two


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text"), "n_bytes": F.octet_length("text")})


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, text keys, n_words, all_sha256, is_copy; doc_id, text keys, text, `starts`: windows that also start in a smaller doc_id).

    The second table has the rows with such windows only, and exact copies of a smaller doc_id's text aren't in it.
    """
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"window must be at least {PERIOD}")
    texts = keyed_texts(docs, id_col, text_col)
    known = stored(texts.mapInArrow(digests, "doc_id long, h1 long, h2 int, n_bytes int, n_words long, all_sha256 string"), "digests")
    firsts = known.where("doc_id is not null").groupBy(*KEYS).agg(F.min("doc_id").alias("first_id"))
    every = known.join(firsts, KEYS, "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(words):
            at = cover_positions(len(words), width) if len(words) >= window else NONE
            return (hashes(words, at, width),)

        return listed(run, batches, ["doc_id", "hash"])

    anchored = id_and_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(anchors, "doc_id long, hash long")
    shared = anchored.groupBy("hash").count().where("count > 1").select("hash")  # of one document only: harmless
    shared = stored(shared, "shared")  # apart from the join, whose hot hashes can be split then
    marked = anchored.join(shared, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    sources = firsts.select(*KEYS, F.col("first_id").alias("doc_id"))
    wanted = stored(marked.join(sources, "doc_id"), "anchors")
    candidates = stored(texts.where("doc_id is not null").join(wanted, ["doc_id", *KEYS]).dropDuplicates(["doc_id", *KEYS]).withColumn("row", F.monotonically_increasing_id()), "candidates")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(words, doc, wanted_hashes):
            at = cover_positions(len(words), width)
            at = at[np.isin(hashes(words, at, width), wanted_hashes)]
            starts = (at[:, None] - np.arange(PERIOD)[None, :]).ravel()  # windows that hold the anchor whole
            starts = np.unique(starts[(starts >= 0) & (starts <= len(words) - window)])
            return starts.astype(np.int32), hashes(words, starts, window), np.full(len(starts), doc)

        return listed(run, batches, ["row", "pos", "hash", "doc_id"])

    placed = candidates.select("row", "text", "doc_id", "hashes").mapInArrow(windows, "row long, pos int, hash long, doc_id long")
    smallest = placed.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "least")
    smallest = stored(smallest, "smallest")
    repeats = placed.join(smallest, "hash").where("least < doc_id").groupBy("row").agg(F.collect_list("pos").alias("starts"))
    return every, candidates.join(repeats, "row").select("doc_id", *KEYS, "text", "starts")


def kept_words(words: list[bytes], starts: list[int], window: int) -> list[bytes]:
    """The words that none of the windows covers."""
    change = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def rewritten(found: DataFrame, window: int) -> DataFrame:
    """doc_id, text keys, kept text and the number of words kept, of rows with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_words(t.split(), s, window) for t, s in zip(batch.column(4).cast(pa.binary()).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            text = pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text, pa.array(list(map(len, kept)), pa.int64())], ["doc_id", *KEYS, "kept_text", "n_kept"])

    return found.mapInArrow(run, "doc_id long, h1 long, h2 int, n_bytes int, kept_text string, n_kept long")


def drop_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_words, n_removed and kept_sha256."""
    every, found = repeated_windows(docs, window, id_col, text_col)
    changed = rewritten(found, window).select("doc_id", *KEYS, "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))
    whole = F.col("is_copy") & (F.col("n_words") >= window)
    out = every.join(changed, ["doc_id", *KEYS], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs; a text that loses words becomes its kept words joined by one space, others stay as they are."""
    every, found = repeated_windows(docs, window, id_col, text_col)
    emptied = every.where(F.col("is_copy") & (F.col("n_words") >= window)).select("doc_id", *KEYS, F.lit("").alias("kept_text"))
    changed = rewritten(found, window).select("doc_id", *KEYS, "kept_text").unionByName(emptied).dropDuplicates(["doc_id", *KEYS])
    row = F.col("row")
    text = F.coalesce(row[text_col].cast("string"), F.lit(""))
    on = (row[id_col].cast("long") == F.col("doc_id")) & (F.xxhash64(text) == F.col("h1")) & (F.hash(text) == F.col("h2")) & (F.octet_length(text) == F.col("n_bytes"))
    joined = docs.select(F.struct("*").alias("row")).join(changed, on, "left")
    return joined.select(*[F.coalesce("kept_text", row[c]).alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])
