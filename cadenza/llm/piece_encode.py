"""Operator 1: exact sentencepiece BPE encoding by backtracking, and decoding.

Encoding takes the longest vocabulary match at each position (one Aho-Corasick pass over a pre-token
gives them all), accepts it when it is compatible with the token before it, else tries the token's
longest proper prefix in the vocabulary, else steps back and marks the position as failed in a
bitfield, so no position fails twice. Two adjacent tokens are compatible when merging their joined
text again gives exactly these two. A sequence whose neighbours are all compatible is the BPE result.

One pass over the documents, no shuffle. Null text: empty, which gives the end id alone. A null doc_id
is carried through. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.pieces import MARK, Pieces
from cadenza.llm.shared import Memo, id_and_text

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Encodes and decodes with a model; pre-tokens seen before come from a bounded cache."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.p = pieces
        self.automaton = ahocorasick.Automaton()
        for piece in pieces.id:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        for piece in pieces.id:
            cut = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in pieces.id), None)
            if cut:
                self.shorter[piece] = cut
        self.pairs: dict[tuple[str, str], bool] = {}
        self.name = {piece: str(i) for piece, i in pieces.id.items()}
        self.plain = {str(i): pieces.text[i].replace(MARK, " ") for i in pieces.id.values()}
        self.stems = Memo(self.encode_stem, 100_000)
        self.encoded = Memo(self.encode_word, 400_000)
        self.decoded = Memo(self.decode_word, 400_000, longest=200)

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b again gives a and b."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.p.merge(a + b, stop_at=len(a)) == [a, b]
        return found

    def encode_run(self, run: str) -> list[str]:
        """Pieces of a run of known characters, by backtracking."""
        n = len(run)
        longest = [""] * n
        for end, (size, piece) in self.automaton.iter(run):
            longest[end + 1 - size] = piece  # matches come by their ends, so the last that begins here is the longest
        failed = bytearray(n // 8 + 1)  # bit k: position k has failed
        pairs, compatible, shorter = self.pairs.get, self.compatible, self.shorter.get
        out: list[str] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while token:
                end = pos + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or (compatible(last, token) if (fits := pairs((last, token))) is None else fits)):
                    break
                token = shorter(token)
            if token:
                out.append(token)
                pos += len(token)
                token = longest[pos] if pos < n else None
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
        return out

    def encode_stem(self, stem: str) -> str:
        """The ids of an independent part of a pre-token, as text."""
        if stem in self.name and self.p.merge(stem) == [stem]:
            return self.name[stem]
        if self.p.runs.fullmatch(stem):
            return " ".join(map(self.name.__getitem__, self.encode_run(stem)))
        ids: list[str] = []
        for known, part in self.p.parts(stem):
            if known:
                ids += map(self.name.__getitem__, self.encode_run(part))
            else:
                ids += [str(self.p.byte_id.get(b, self.p.unknown)) for b in part.encode()]
        return " ".join(ids)

    def encode_word(self, pre_token: str) -> str:
        if pre_token[1:].isalpha():  # letters after a mark or another letter: nothing to take apart
            return self.encode_stem(pre_token)
        return " ".join(map(self.stems.__getitem__, self.p.smaller(pre_token)))

    def decode_word(self, ids: str) -> str:
        try:
            return "".join(map(self.plain.__getitem__, ids.split(" ")))
        except KeyError:  # bytes, or an id without a text of its own
            return self.decode_ids(map(int, ids.split()))

    def decode_ids(self, ids) -> str:
        """Text of the ids, with the dummy prefix still in place; a broken byte becomes U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.p.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.p.special:
                out.append(self.p.text[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[str]:
        """The ids as text, a string for each pre-token."""
        return list(map(self.encoded.__getitem__, self.p.pre_tokens(text)))

    def decode(self, parts: list[str]) -> str:
        """The text of encode()'s parts; ids of one pre-token never share a character with the next."""
        return "".join(map(self.decoded.__getitem__, parts)).removeprefix(" ")


_ready: dict[int, Encoder] = {}


def encoder(blob: bytes) -> Encoder:
    """One encoder for each model and Python worker."""
    key = hash(blob)
    if key not in _ready:
        _ready[key] = Encoder(Pieces(blob))
    return _ready[key]


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document the ids' and the decoded text's digests and the number of ids, an end id included.

    keep_ids adds `ids` (array of int) and `decoded` (string).
    """
    blob = docs.sparkSession.sparkContext.broadcast(model)
    schema = SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = enc.encode(text)
                ids = " ".join([*parts, str(enc.p.eos)])
                decoded = enc.decode(parts)
                counts.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append([int(x) for x in ids.split()])
                    texts.append(decoded)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
