"""Operator 5: best-fit packing by patterns fitted with non-negative least squares.

Every document becomes ids (the tokenizer's, then an end id); only longer ones are cut into pieces of
the capacity. The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) goes to the
driver. There patterns of few documents that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded within what the histogram holds, and the
residual is packed by best fit decreasing on counts, not on documents. The plan says which ranks among
the pieces of one length go to which sequences; its size is bounded by `max_patterns` and the capacity.

Ranks are dealt within (length, chunk) groups, about the square root of the number of pieces each way, so
a length that a third of all pieces share is spread over all tasks.

Null text: empty, one end id. A null doc_id is carried through. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import Memo, id_and_text, stored

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BITS = 44


#: The tokenizer's own splitting always cuts between a letter and other ASCII punctuation than an apostrophe.
WITHIN = re.compile(r"(?<=[^\W\d_])(?=[!-&(-/:-@\[-^`{-~])")

WHOLE = re.compile("<[|]|[\u03a3\u0130]")


#: How the tokenizers that may be asked word by word normalise and split.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [{"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def by_word(definition: dict) -> bool:
    """Whether a tokenizer drops white space, joins nothing across it and lower-cases, as WordIds takes for granted."""
    parts = (definition.get("normalizer") or {}).get("normalizers"), (definition.get("pre_tokenizer") or {}).get("pretokenizers")
    special = all(t["content"].startswith("<|") for t in definition.get("added_tokens", []))
    return parts == (NORMALIZERS, SPLITTERS) and definition["model"]["type"] == "BPE" and special


class WordIds:
    """A text's ids as little-endian bytes, word by word: the tokenizer drops white space and joins nothing across it. Texts
    of a tokenizer that is defined otherwise go to it whole.

    Words with a special token's opening, a capital sigma (its lower case depends on what follows) or a dotted
    capital i (its lower case ends in a mark) stay whole.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.apart = by_word(json.loads(blob))
        self.model = self.tokenizer.model
        byte_level = [b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)]
        spare = iter(range(256, 512))  # bytes without a printable character of their own, in order
        self.letters = {b: chr(next(spare) if c is None else c) for b, c in enumerate(byte_level)}
        self.stems, self.words = Memo(self._part, 800_000), Memo(self._word, 500_000)
        self.words[""] = b""

    def _part(self, part: str) -> bytes:
        if part.isalpha() and max(part) < "\u0250" and "\u0130" not in part and unicodedata.is_normalized("NFC", part):
            low = part.lower()  # letters only: what the tokenizer's model gets after normalising and splitting
            if not low.isascii():
                low = "".join(map(self.letters.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha() or WHOLE.search(word):
            return self.stems[word]
        return b"".join(map(self.stems.__getitem__, WITHIN.split(word)))

    def encode_all(self, texts: list[str], end: bytes) -> Iterator[bytes]:
        for text in texts:
            if not self.apart:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + end
                continue
            yield b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) + end


_ready: dict[int, WordIds] = {}


def pieces_of(docs: DataFrame, tokenizer: bytes, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = shipped.value
        ids = _ready.setdefault(hash(blob), None) or WordIds(blob)
        _ready[hash(blob)] = ids
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc, raw in zip(part.column(0).to_pylist(), ids.encode_all(part.column(1).to_pylist(), end), strict=True):
                    for k, a in enumerate(range(0, len(raw), step)):
                        cut = raw[a : a + step]
                        rows.append((doc, k, a // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def patterns_for(hist: np.ndarray, capacity: int, max_patterns: int) -> list[tuple[int, ...]]:
    """Patterns of one to six documents that sum to the capacity exactly, lengths in falling order."""
    present = np.flatnonzero(hist)
    present = present[(present > 0) & (present < capacity)]
    if not len(present):
        return []
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    found = {(int(a), capacity - int(a)) if 2 * a >= capacity else (capacity - int(a), int(a)) for a in present if has[capacity - a]}
    common = present[np.argsort(-(hist[present] * present), kind="stable")]
    heads: list[tuple[int, ...]] = [(int(a),) for a in common]
    for size in range(2, 6):
        heads = [tuple(sorted((*h, int(a)), reverse=True)) for h in heads[: max_patterns // 20] for a in common[:24] if sum(h) + a < capacity]
        heads = list(dict.fromkeys(heads))
        for h in heads:
            rest = capacity - sum(h)
            if has[rest]:
                found.add(tuple(sorted((*h, rest), reverse=True)))
        if len(found) >= max_patterns:
            break
    return sorted(found)[:max_patterns] if len(found) <= max_patterns else sorted(found, key=lambda p: (-min(hist[x] for x in p), p))[:max_patterns]


def fit_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares of repeat counts against the histogram, by accelerated projected gradient."""
    widest = max(map(len, patterns))
    cells = np.array([(*p, *[0] * (widest - len(p))) for p in patterns])
    weight = (cells > 0).astype(float)
    target = hist.astype(float)
    usage = np.bincount(cells.ravel(), weight.ravel(), len(hist))
    step = 1 / max(1.0, (usage[cells] * weight).sum(1).max())  # at most the inverse of the largest curvature
    x = np.zeros(len(patterns))
    ahead, t = x, 1.0
    for _ in range(rounds):
        left = np.bincount(cells.ravel(), (weight * ahead[:, None]).ravel(), len(hist)) - target
        new = np.maximum(0, ahead - step * (left[cells] * weight).sum(1))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, x = new + (before - 1) / t * (new - x), new
    return x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on counts: [([(length, copies in one sequence)], sequences)]."""
    by_room: dict[int, list[list]] = {}  # room: groups of equal sequences, [runs, sequences]
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(hist)[::-1]:
        length, count = int(length), int(hist[length])
        while count:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                for copies, many in ((each, count // each), (count % each, 1)):
                    if copies and many:
                        by_room.setdefault(capacity - copies * length, []).append([[(length, copies)], many])
                        rooms[capacity - copies * length] = True
                count = 0
                break
            room = length + int(fits[0])
            group = by_room[room][-1]
            each = min(room // length, count)
            many = min(group[1], count // each)
            group[1] -= many
            if not group[1]:
                by_room[room].pop()
                rooms[room] = bool(by_room[room])
            by_room.setdefault(room - each * length, []).append([[*group[0], (length, each)], many])
            rooms[room - each * length] = True
            count -= many * each
    return [(runs, many) for groups in by_room.values() for runs, many in groups]


def plan_sequences(hist: np.ndarray, capacity: int, max_patterns: int = 20_000) -> np.ndarray:
    """Rows (first key, last key, copies in a sequence, first sequence, offset); a key is length << RANK_BITS | rank."""
    left = hist.astype(np.int64).copy()
    chosen: list[tuple[list[tuple[int, int]], int]] = []
    if patterns := patterns_for(left, capacity, max_patterns):
        counts = np.floor(fit_counts(patterns, left) + 0.5).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            runs = [(n, patterns[k].count(n)) for n in dict.fromkeys(patterns[k])]
            many = min(int(counts[k]), *(int(left[n]) // c for n, c in runs))
            if many:
                chosen.append((runs, many))
                for n, c in runs:
                    left[n] -= c * many
    chosen += best_fit(left, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for runs, many in chosen:
        offset = 0
        for length, copies in runs:
            first = (length << RANK_BITS) + int(used[length])
            rows.append((first, first + copies * many, copies, sequence, offset))
            used[length] += copies * many
            offset += length * copies
        sequence += many
    if not np.array_equal(used[1:], hist[1:]):
        raise AssertionError("the plan doesn't hold every piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: bytes, capacity: int = 4096, end_id: int = 1, max_patterns: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    pieces = stored(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[length] = count
    plan = pieces.sparkSession.sparkContext.broadcast(plan_sequences(hist, capacity, max_patterns))

    chunks = max(1, math.isqrt(int(hist.sum())))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "chunk"])
    keyed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.shiftleft("length", RANK_BITS) + F.col("first") + F.col("rank")).alias("key"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for batch in batches:
            key, length = (batch.column(n).to_numpy(zero_copy_only=False) for n in (5, 3))
            slot = slots[np.searchsorted(slots[:, 0], key, "right") - 1]
            at, copies = key - slot[:, 0], slot[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slot[:, 3] + at // copies), pa.array(slot[:, 4] + at % copies * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return keyed.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
