"""Operators 1, 3 and 5 against the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm.packing import pack
from cadenza.llm.piece_encode import encode_documents
from cadenza.llm.queries import PIECE_MODEL, WORD_MODEL, tokenizer_file
from cadenza.llm.token_count import count_tokens

from . import cases


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(PIECE_MODEL)))


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(str(public_tokenizers.path(WORD_MODEL)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def inputs(spark, kind):
    texts = cases.TEXTS if kind == "odd" else cases.documents()
    return texts, cases.table(spark, texts)


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_pieces_are_the_librarys(spark, sp, kind):
    texts, docs = inputs(spark, kind)
    want = []
    for i, t in texts:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = encode_documents(docs, tokenizer_file(PIECE_MODEL)).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_pieces_can_be_kept(spark, sp):
    for r in encode_documents(cases.odd(spark).where("doc_id in (6, 13)"), tokenizer_file(PIECE_MODEL), keep_ids=True).collect():
        text = dict(cases.TEXTS)[r.doc_id]
        assert list(r.ids) == sp.encode(text, add_eos=True)
        assert r.decoded == sp.decode(list(r.ids))


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_counts_are_the_librarys(spark, sp, kind):
    texts, docs = inputs(spark, kind)
    want = []
    for i, t in texts:
        n = len(sp.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert Counter(map(tuple, count_tokens(docs, tokenizer_file(PIECE_MODEL)).collect())) == Counter(want)


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_packing_holds_every_token_once(spark, words, kind):
    texts, docs = inputs(spark, kind)
    want = Counter()
    total = 0
    for i, t in texts:
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = pack(docs, tokenizer_file(WORD_MODEL)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) <= -(-total // 4096) * 1.02 + 1


def test_empty_tables(spark):
    none = cases.empty(spark)
    assert encode_documents(none, tokenizer_file(PIECE_MODEL)).count() == 0
    assert count_tokens(none, tokenizer_file(PIECE_MODEL)).count() == 0
    assert pack(none, tokenizer_file(WORD_MODEL)).count() == 0


def test_long_texts_without_spaces(spark, sp):
    """Time and memory follow the length: a run of a third of a megabyte, and one whose every position fails or fits alike."""
    rng = random.Random(5)
    texts = [(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(300_000))), (2, "a" * 100_000)]
    got = {r.doc_id: r.n_tokens for r in encode_documents(cases.table(spark, texts), tokenizer_file(PIECE_MODEL)).collect()}
    assert got == {i: len(sp.encode(t, add_eos=True)) for i, t in texts}


def test_a_tokenizer_defined_otherwise_gets_whole_texts(spark):
    """Byte-level splitting keeps spaces with words: word by word its ids would be wrong."""
    from cadenza.llm import packing

    blob = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_str(blob.decode())
    assert packing.WordIds(tokenizer_file(WORD_MODEL)).apart and not packing.WordIds(blob).apart
    texts = [(k, t) for k, t in enumerate(["two  words", " Upper Case\n\nline", "", "word " * 5000])]
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in pack(cases.table(spark, texts), blob).collect()}
    for k, t in texts:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for p in range(-(-len(ids) // 4096)):
            cut = ids[p * 4096 : (p + 1) * 4096]
            assert got[k, p] == (len(cut), zlib.crc32(cut.tobytes()))
