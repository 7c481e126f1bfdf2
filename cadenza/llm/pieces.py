"""Vocabulary of a sentencepiece BPE model with byte fallback, and its merges, as both piece operators use it.

The text model: spaces become U+2581, one such mark is put in front of a text that isn't empty, and
merges join neighbouring pieces whose concatenation is in the vocabulary, best score first, the
leftmost first among equals. Characters outside the vocabulary become one piece per UTF-8 byte.

A merge never joins two characters that don't stand beside each other inside any piece. No piece
has a mark after another character, a line feed, or ASCII punctuation straight after a letter (checked
when a model is loaded), so a text falls into independent pre-tokens at these places; the result of a
repeated pre-token is kept in a bounded cache.
"""

from __future__ import annotations

import re

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LETTER, PUNCTUATION = r"[^\W\d_¹²³]", r"[!-/:-@\[-^`{-~]"
WITHIN = re.compile(f"(?<={LETTER})(?={PUNCTUATION})")
UNSAFE = re.compile(f"\n|[^{MARK}]{MARK}|{LETTER}{PUNCTUATION}")


class Pieces:
    """Pieces, scores and byte ids of a model given as the bytes of its file."""

    def __init__(self, blob: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        proto = model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("a BPE model with the identity normaliser and a dummy prefix is needed")
        kinds = proto.SentencePiece.Type
        if any(piece.type in (kinds.USER_DEFINED, kinds.UNUSED) for piece in proto.pieces):
            raise ValueError("a model with user-defined or unused pieces isn't handled")
        sp = SentencePieceProcessor(model_proto=blob)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.eos, self.unknown = sp.eos_id(), sp.unk_id()
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.special = special
        self.id = {self.text[i]: i for i in ids if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.known = {c for p in self.id for c in p if c in self.id}
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece has a character that isn't a piece")
        self.splits = not any(map(UNSAFE.search, self.id))
        odd = "".join(sorted(self.known))
        self.runs = re.compile("([" + re.escape(odd) + "]+)") if odd else re.compile("(.+)", re.S)

    def pre_tokens(self, text: str) -> list[str]:
        """Independent parts of a text, together the whole of it in the model's alphabet."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return PRE_TOKEN.findall(marked) if self.splits else [marked]

    def smaller(self, pre_token: str) -> list[str]:
        """A pre-token's own independent parts: punctuation after a letter begins another."""
        return WITHIN.split(pre_token) if self.splits else [pre_token]

    def parts(self, pre_token: str):
        """(True, run of characters in the vocabulary) and (False, other characters), in order."""
        for k, part in enumerate(self.runs.split(pre_token)):
            if part:
                yield bool(k % 2), part

    def merge(self, run: str, stop_at: int = -1) -> list[str] | None:
        """Pieces of a run of known characters by merging; None as soon as a merge crosses character `stop_at`."""
        parts, score = list(run), self.score
        if len(parts) > 64:
            return self.merge_long(run)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            if stop_at >= 0 and sum(map(len, parts[: at + 1])) == stop_at:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, run: str) -> list[str]:
        """The same by a heap, for long runs."""
        import heapq

        n = len(run)
        part, after, before = list(run), [*range(1, n), -1], list(range(-1, n - 1))
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, len(part[a]) + len(part[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not part[a] or not part[b] or after[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            part[a], part[b] = part[a] + part[b], ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]
