"""Operator 6: document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of character classes and of words
repeated at once, its length and its ending, its own and those of the lines before and after. The field is fitted on the lines of a bounded, hash-chosen sample of
labelled documents (at most `per_label` of each label), each line carrying its document's label, by gradient
ascent on the conditional likelihood. Forward-backward gives each line's marginal; their average weighted
by line length, turned into log odds and calibrated on the sample, is the document's score.

Null or empty text: one empty line, scored like any other. Rows without a label are scored, and none is learned
from if it is held out. Of several labels of one id the smallest counts. Without labels of both kinds every score
is 0.5. Repeated rows are each returned. Columns besides id and text are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import held_out, id_and_text

UPPER, LETTER, DIGIT, SPACE, SHOUT, BAR, SIGN, STOP = range(8)
CLASS = np.full(256, SIGN, np.uint8)
for kind, chars in ((UPPER, range(65, 91)), (LETTER, [*range(97, 123), *range(128, 256)]), (DIGIT, range(48, 58)), (SPACE, b" \t\r\x0b\x0c"), (SHOUT, b"!"), (BAR, b"|"), (STOP, b".,;:?'\"()-")):
    CLASS[list(chars)] = kind


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x own features, bytes of each line, lines of each text)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(float)
    kinds = CLASS[raw]
    n = np.zeros((8, len(ends)))
    for k in range(8):
        upto = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int64)))
        n[k] = upto[ends] - upto[starts]
    some = size + 1
    words = n[SPACE] + 1
    # words equal to the word before in the same line, told by length and byte sum
    gaps = np.flatnonzero((kinds == SPACE) | (raw == 10))
    begin = np.concatenate(([0], gaps[:-1] + 1))
    total = np.concatenate(([0], np.cumsum(raw, dtype=np.int64)))
    span, mass = gaps - begin, total[gaps] - total[begin]
    line_of = np.searchsorted(ends, gaps)
    again = (span[1:] == span[:-1]) & (mass[1:] == mass[:-1]) & (span[1:] > 0) & (line_of[1:] == line_of[:-1])
    same = np.bincount(line_of[1:][again], minlength=len(ends))
    full = (size > 0) & (raw[np.maximum(ends - 1, 0)] == ord("."))
    own = [np.log1p(size) / 5, n[UPPER] / (n[UPPER] + n[LETTER] + 1), (n[UPPER] + n[LETTER]) / some, n[DIGIT] / some, n[SPACE] / some, np.minimum(1, 3 * n[SHOUT] / words), np.minimum(1, 3 * n[BAR] / words), np.minimum(1, 3 * n[SIGN] / words), np.minimum(1, n[STOP] / words), np.minimum(1, 2 * same / words), full, size == 0]
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    return np.stack(own, 1).astype(float), size, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after (zero beyond the text), and one."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = 0
    after[last] = 0
    return np.concatenate((own, before, after, np.ones((len(own), 1))), 1)


def marginals(good: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) by forward-backward, and the expected moves summed over texts (2 x 2).

    good: log odds of good for each line by its own features; moves[a, b]: weight of b after a.
    """
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    at, count = first[order], lines[order]
    e = np.stack((np.zeros_like(good), good), 1)
    e = np.exp(e - e.max(1, keepdims=True))
    m = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), "left")  # texts with more than t lines
    for t in range(longest):
        k = at[: active[t]] + t
        a = e[k] if t == 0 else (alpha[k - 1] @ m) * e[k]
        alpha[k] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        k = at[: active[t + 1]] + t
        ahead = e[k + 1] * beta[k + 1]
        b = ahead @ m.T
        beta[k] = b / b.sum(1, keepdims=True)
        joint = alpha[k][:, :, None] * m[None] * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


def document_odds(p: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of line marginals."""
    first = np.cumsum(lines) - lines
    weight = size + 1
    mean = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit_field(texts: list[bytes], labels: np.ndarray, rounds: int = 250) -> dict:
    """Weights of the field and of the calibration; texts of both labels count alike while lines are fitted."""
    own, size, lines = line_features(texts)
    x = with_neighbours(own, lines)
    y = np.repeat(labels, lines).astype(float)
    per_doc = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w_line = np.repeat(per_doc / lines, lines)
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    goods = y[1:] * y[:-1]
    inside = np.ones(len(y), bool)
    inside[np.cumsum(lines) - lines] = False
    seen = np.array([[((1 - y[1:]) * (1 - y[:-1]) * inside[1:]).sum(), 0], [0, (goods * inside[1:]).sum()]])  # lines of one text have one label
    total = max(1.0, seen.sum())
    for step in range(1, rounds + 1):
        p, pairs = marginals(x @ w, lines, moves)
        grad = np.concatenate((x.T @ (w_line * (y - p)) - 1e-4 * w, ((seen - pairs) / total - 1e-2 * moves).ravel()))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    odds = document_odds(marginals(x @ w, lines, moves)[0], size, lines)
    return {"w": w, "moves": moves, "odds": odds}


def calibrate(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, by Newton's steps with a little shrinkage."""
    x = np.stack((odds, np.ones_like(odds)), 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.linalg.solve(hess, x.T @ (weights * (labels - p)) - 1e-3 * b)
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 65_536, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """The model from about `per_label` labelled rows of each label that aren't held out and have at most `longest` bytes; None without both labels."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    order = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    bound = F.coalesce(*[F.when(F.col("label") == k, F.lit(int((1 << 30) * min(1.0, per_label / n)))) for k, n in sizes.items()])
    chosen = known.where(order < bound)  # about per_label rows of each label
    rows = id_and_text(docs, id_col, text_col).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text").distinct().collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    model = fit_field([r[2].encode() for r in rows], y)
    share = {k: sizes[k] / max(1, int((y == k).sum())) for k in sizes}
    weights = np.array([share[int(k)] for k in y])
    model["scale"] = calibrate(model.pop("odds"), y, weights / weights.mean())
    return model


def score_texts(texts: list[bytes], model: dict | None) -> np.ndarray:
    """Scores of some texts."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    own, size, lines = line_features(texts)
    p, _ = marginals(with_neighbours(own, lines) @ model["w"], lines, model["moves"])
    a, b = model["scale"]
    return 1 / (1 + np.exp(-np.clip(a * document_odds(p, size, lines) + b, -30, 30)))


def scored(docs: DataFrame, model: dict | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, held_out, score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [score_texts(texts.slice(at, 500).to_pylist(), shipped.value) for at in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "held_out", "score"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: dict | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all columns; all rows if there is no model."""
    if model is None:
        return docs
    shipped, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(score_texts(texts, shipped.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
