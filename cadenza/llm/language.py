"""Operator 9: language by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased, ASCII characters that aren't letters become spaces, and its byte 3-grams are counted in `BUCKETS` hashed
features. Weights are (1 + log count) * idf, scaled to length one. Document frequencies cover every row that may
be learned from. Each language has several centroids, found by spherical k-means on a bounded, hash-chosen
sample of at most `per_language` rows of it, of at most `longest` bytes each. A text gets the language of the centroid with the largest cosine;
`rejected` marks a text further from it than nearly all sample rows of that language are from theirs.

Null text, or none with a letter: `und`, score 0, rejected. Rows with a null language are predicted but not learned
from; with nothing to learn from every row is `und`. Repeated rows are each returned. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import held_out, id_and_text

BUCKETS = 1 << 13
ASCII = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Signs such as ² and Ⅷ aren't letters."""
    return any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """Counts of the hashed byte 3-grams, one row a text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(ASCII).split()) + b" ", np.uint8).astype(np.uint32)
        if len(raw) > 2:
            grams = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
            row += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
    return out


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one (zero stays zero)."""
    v = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def centroids(v: np.ndarray, k: int, seed: int = 7, rounds: int = 15) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, per_language: int = 300, per_centroid: int = 3, longest: int = 65_536, languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model: languages, centroids, idf and the cosine below which a text is rejected.

    It learns the `languages` values of lang that most rows have, so a dirty column doesn't make it grow.
    """
    learn = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    commonest = learn.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages)
    sizes = {r[0]: r[1] for r in commonest.collect()}
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen += (counts(part.column(1).to_pylist()) > 0).sum(0)
                rows += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1), pa.int64()), pa.array(np.append(seen, rows))], ["feature", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in id_and_text(learn, id_col, text_col).mapInArrow(frequencies, "feature long, n long").groupBy("feature").sum("n").collect():
        df[r[0]] = r[1]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    # rows with the smallest hashes of a language; the filter keeps a little over the bound, the slice the bound
    order = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    bound = F.coalesce(*[F.when(F.col(lang_col).cast("string") == k, F.lit(int((1 << 30) * min(1.0, (per_language * 1.3 + 20) / n)))) for k, n in sizes.items()])
    rows = learn.where((order < bound) & (F.octet_length(F.col(text_col).cast("string")) <= longest)).select(F.col(lang_col).cast("string"), F.col(text_col), order.alias("o"), F.col(id_col)).collect()
    names, found, near = [], [], []
    for lang in sorted(sizes):
        texts = [r[1] for r in sorted((r for r in rows if r[0] == lang and has_letter(r[1])), key=lambda r: (r[2], r[3]))[:per_language]]
        if texts:
            v = weighted(counts(texts), idf)
            c = centroids(v, per_centroid)
            names += [lang] * len(c)
            found.append(c)
            near += [float(np.quantile((v @ c.T).max(1), 0.005))] * len(c)
    return {"names": names, "centroids": np.concatenate(found), "idf": idf, "near": np.array(near)} if found else None


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, held_out, lang_pred, score (cosine, 0 to 1) and rejected."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                lettered = np.array([m is not None and has_letter(t) for t in texts])
                if m is None:
                    cos, best = np.zeros(len(texts)), np.zeros(len(texts), int)
                else:
                    all_cos = weighted(counts(texts), m["idf"]) @ m["centroids"].T
                    best = np.argmax(all_cos, axis=1)
                    cos = all_cos[np.arange(len(texts)), best]
                langs += [m["names"][b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, np.clip(cos, 0, 1), 0.0).astype(float))
                rejected.append(~lettered | (cos < (m["near"][best] if m else 1)))
            if langs:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
