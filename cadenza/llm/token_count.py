"""Operator 3: token counts with a whole-token shortcut.

Before any document is read, every vocabulary string is merged by itself; those that come out as one token
are proved. A pre-token that is such a string counts one; only the other pre-tokens are merged, once
for each time they enter a bounded cache.

One pass, no shuffle. Null text: empty, no tokens. A null doc_id is carried through; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.pieces import Pieces
from cadenza.llm.shared import Memo, id_and_text


def proved_whole(pieces: Pieces) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token."""
    return frozenset(p for p in pieces.id if pieces.merge(p) == [p])


class Counter:
    """Counts tokens of texts."""

    def __init__(self, pieces: Pieces, whole: frozenset[str]):
        self.p, self.whole = pieces, whole
        self.stems = Memo(self.count_part)
        self.counts = Memo(self.count_pre_token)

    def count_part(self, part: str) -> int:
        if part in self.whole:
            return 1
        return sum(len(self.p.merge(run)) if known else len(run.encode()) for known, run in self.p.parts(part))

    def count_pre_token(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else sum(map(self.stems.__getitem__, self.p.smaller(pre_token)))

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.p.pre_tokens(text)))


_ready: dict[int, Counter] = {}


def counter(blob: bytes, whole: frozenset[str] | None = None) -> Counter:
    """One counter for each model and Python worker."""
    key = hash(blob)
    if key not in _ready:
        pieces = Pieces(blob)
        _ready[key] = Counter(pieces, proved_whole(pieces) if whole is None else whole)
    return _ready[key]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    whole = proved_whole(Pieces(model))
    shipped = docs.sparkSession.sparkContext.broadcast((model, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*shipped.value).count
        for batch in batches:
            n = [count(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
