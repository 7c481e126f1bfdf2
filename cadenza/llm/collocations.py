r"""Operator 13: phrases of two and three words that stay together, by Toivonen's mining.

A phrase can only be frequent if its parts are. A sample of the documents, mined with a lowered threshold, proposes words and
pairs. The first full pass counts exactly all phrases whose parts were proposed, which are the proposals and their
negative border, all words among them. Where border phrases turn out frequent the proposals grow by them, and another full pass counts what that adds to the
border and no earlier pass has counted, until no border phrase fails: with phrases of at most three words that is two more passes
at most. The sample only decides how much the first pass can count, never a result.

Proposals are kept as bitmaps of a fixed size, addressed by a hash, so what is broadcast is bounded whatever the corpus. A
phrase that meets a foreign bit is counted without need, exactly like the others; a phrase whose parts are proposed always is.
Counting runs in Python over arrays of word numbers, a bounded buffer at a time; each buffer's counts go through one
shuffle by phrase, and only frequent phrases are stored.

Defined results: a null text is empty, a null lang is `und`; repeated rows count as often as they occur; an empty table gives no rows;
other columns are ignored, whatever their names. Words and their order are told by bytes. f must stay below 10**15 for scores to be exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import small_batches, stored

COUNTS = "lang string, words int, phrase string, f long"
BITS = 25  # of a bitmap's address: 4 MB for words and 4 MB for pairs in each pass
BREAK = b"\xff"  # in no UTF-8 text
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")


def slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text and BREAK between its pieces, a bounded slice at a time."""
    text = text.translate(LOWER)
    at = 0
    while at < len(text):
        upto = at + size
        if upto < len(text):
            cuts = [k for k in (text.find(b" ", upto), text.find(b"\n", upto)) if k >= 0]
            upto = min(cuts, default=len(text))
        yield text[at:upto].replace(b"\n", b" \xff ").split()
        at = upto


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << BITS) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Buffer:
    """Words of one lang as numbers; number 0 is the border between pieces."""

    def __init__(self, lang: str):
        self.lang, self.carried = lang, 0
        self.start([])

    def start(self, words: list[bytes]) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)  # not the dict's own length: a cycle would keep old ones in memory
        self.number[BREAK]
        self.parts = [np.fromiter((self.number[w] for w in words), np.int32, len(words))]
        self.carried = len(words)

    def add(self, words: list[bytes]) -> int:
        number = self.number
        self.parts.append(np.fromiter((number[w] for w in words), np.int32, len(words)))
        return len(words)

    def counts(self, states: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(words, their numbers by position in the phrase, occurrences) of the phrases that the last state admits and none before it.

        The first state's come with an empty phrase of no words: all occurrences of words.
        """
        ids, words = np.concatenate(self.parts), list(self.number)
        self.parts = [ids]
        if len(states) == 1:
            n = np.bincount(ids[self.carried :], minlength=len(words))
            n[0] = 0
            yield 0, [np.zeros(1, np.int64)], n.sum(keepdims=True)
            found = np.flatnonzero(n)
            yield 1, [found], n[found]
        h = word_hashes(words, self.lang)
        whole = (ids[:-1] != 0) & (ids[1:] != 0)
        fresh = np.arange(1, len(ids), dtype=np.int32) >= self.carried  # by the phrase's end, so what a buffer carries over isn't counted twice
        pairs, triples = whole & fresh, whole[:-1] & whole[1:] & fresh[1:]
        for k, (word_bits, pair_bits) in enumerate(states):
            known = holds(word_bits, h)[ids]
            pair, part = known[:-1] & known[1:], np.empty(len(whole), bool)
            for at in range(0, len(whole), 1 << 18):  # hashes of all positions would take as much memory as all the rest
                upto = min(len(whole), at + (1 << 18))
                part[at:upto] = holds(pair_bits, pair_hashes(h[ids[at:upto]], h[ids[at + 1 : upto + 1]]))
            triple = part[:-1] & part[1:]
            last = k == len(states) - 1
            pairs &= pair if last else ~pair
            triples &= triple if last else ~triple
        low = (1 << 21) - 1
        for size, chosen in ((2, pairs), (3, triples)):
            at = np.flatnonzero(chosen)
            code = ids[at].astype(np.int64)
            for k in range(1, size):
                code <<= 21
                code |= ids[at + k]
            del at
            code.sort()
            new = np.flatnonzero(np.diff(code, prepend=-1))
            yield size, [code[new] >> 21 * k & low for k in reversed(range(size))], np.diff(new, append=len(code))

    def rest(self) -> list[bytes]:
        """The last two words: a phrase may go on."""
        ids, words = np.concatenate(self.parts)[-2:], list(self.number)
        return [words[k] for k in ids]


def counted(docs: DataFrame, states: list, buffer_words: int) -> DataFrame:
    """COUNTS of the phrases that the last state admits and none before it; docs has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Buffer] = {}
        bitmaps = [s.value for s in states]
        size = 0

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            buffer = held[lang]
            words = pa.array(list(buffer.number), pa.binary())
            for length, numbers, n in buffer.counts(bitmaps):
                for k in range(0, len(n), 65_536):
                    parts = [words.take(pa.array(x[k : k + 65_536])) for x in numbers]
                    phrase = (pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0] if length else pa.array([b""])).cast(pa.string())
                    rows = len(phrase)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(rows, np.int64))), pa.array(np.full(rows, length, np.int32)), phrase, pa.array(n[k : k + 65_536])], ["lang", "words", "phrase", "f"])
            buffer.start(buffer.rest())

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in held:
                    held[lang] = Buffer(lang)
                buffer = held[lang]
                for words in slices(text.as_buffer().to_pybytes()):
                    size += buffer.add(words)
                    if len(buffer.number) > 300_000 or size > buffer_words:  # numbers stay below 2**21: a slice has at most half a million words
                        for each in held if size > buffer_words else (lang,):
                            yield from flush(each)
                        if size > buffer_words:
                            size, held = 0, {lang: buffer}
                buffer.add([BREAK])
        for lang in held:
            yield from flush(lang)

    # a buffer's counts are whole, so they are summed after the shuffle only: before it there is nothing to gain for the memory
    return docs.mapInArrow(run, COUNTS).repartition("lang", "words", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def hash_of(words: int, phrases: list[bytes], langs: list[str]) -> np.ndarray:
    """Addresses of words or pairs in their bitmap."""
    by_lang = defaultdict(list)
    for k, lang in enumerate(langs):
        by_lang[lang].append(k)
    out = np.empty(len(phrases), np.uint64)
    for lang, at in by_lang.items():
        parts = [phrases[k].split(b" ") for k in at]
        h = [word_hashes([p[j] for p in parts], lang) for j in range(words)]
        out[at] = h[0] if words == 1 else pair_hashes(h[0], h[1])
    return out & np.uint64((1 << BITS) - 1)


def bitmap(phrases: DataFrame, words: int) -> np.ndarray:
    """The bitmap of the words or pairs among phrases, made by the executors; at most 2**BITS bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(hash_of(words, batch.column(1).to_pylist(), batch.column(0).to_pylist())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["at", "bits"])

    found = phrases.where(F.col("words") == words).select("lang", F.col("phrase").cast("binary"))
    merged = found.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[merged["at"].to_numpy()] = merged["bits"].to_numpy()
    return out.view(np.uint8)


def failures(frequent: DataFrame, state: tuple[np.ndarray, np.ndarray], spark: SparkSession) -> DataFrame:
    """Frequent words and pairs that the state doesn't hold: their border was too small."""
    shared = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for words in (1, 2):
                part = batch.take(pa.array(np.flatnonzero(sizes == words)))
                if part.num_rows:
                    missed = ~holds(shared.value[words - 1], hash_of(words, part.column(2).cast(pa.binary()).to_pylist(), part.column(0).to_pylist()))
                    yield part.filter(pa.array(missed))

    return frequent.where("words in (1, 2)").select("lang", "words", "phrase", "f").mapInArrow(run, COUNTS)


def frequent_phrases(docs: DataFrame, least: int = 10, sample_docs: int = 20_000, lowered: float = 0.8, buffer_words: int = 1_000_000, seed: int = 11) -> tuple[DataFrame, int]:
    """Exact COUNTS of all phrases of one to three words that occur `least` times or more in a lang, with a row of no words for all occurrences of words, and the full passes it took.

    The sample has about `sample_docs` documents; its threshold is `lowered` times what `least` comes to in it, and 2 at least.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    share = min(1.0, sample_docs / max(docs.count(), 1))
    none, every = np.zeros(1 << BITS - 3, np.uint8), np.full(1 << BITS - 3, 255, np.uint8)
    everything = spark.sparkContext.broadcast((every, none))  # the sample counts words and pairs
    with small_batches(spark, 1000):
        sample = stored(counted(plain.sample(share, seed), [everything], buffer_words).where(F.col("f") >= max(2, int(lowered * least * share))), "proposed")
    state = (bitmap(sample, 1), bitmap(sample, 2))
    states, found, passes = [], None, 0
    while True:
        states.append(spark.sparkContext.broadcast(state))
        new = counted(plain, states, buffer_words).where((F.col("f") >= least) | (F.col("words") == 0))
        with small_batches(spark, 1000):
            found = stored(new if found is None else found.unionByName(new), "frequent")
        passes += 1
        missed = stored(failures(found, state, spark), "failures")
        if missed.isEmpty():
            return found, passes
        state = (state[0] | bitmap(missed, 1), state[1] | bitmap(missed, 2))


def whole(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("decimal(38,0)")


def best_phrases(docs: DataFrame, top: int = 2000, least: int = 10, swallowed: int = 50, **mining) -> DataFrame:
    """Each lang's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    The score is floor(10**6 * a * a / (l * r)) at the lowest-scoring cut. Phrases inside a longer one that has `swallowed`
    percent of their occurrences or more are left out.
    """
    plain = docs.select("lang", "text")
    found, _ = frequent_phrases(plain, least, **mining)
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("left"), F.array_join(F.slice(w, k + 1, 2), " ").alias("right"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    cut_rows = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.inline(cuts))
    for side, name in (("left", "l"), ("right", "r")):
        cut_rows = cut_rows.join(parts.select("lang", F.col("part").alias(side), F.col("part_f").alias(name)), ["lang", side])
    score = F.expr("cast(cast(1000000 as decimal(38,0)) * cast(a * cast(a as decimal(38,0)) as decimal(38,0)) as decimal(38,0)) div cast(l * cast(r as decimal(38,0)) as decimal(38,0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = stored(cut_rows.groupBy("lang", "words", "phrase", "a").agg(lowest.alias("cut")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    inside = F.array_distinct(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " ")))
    longer = stored(scored.where("words = 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer")), "longer")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < swallowed * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within slices of each lang, so a task sees at most `top` rows of each slice
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB, by counting every phrase.
ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda t: t <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM spoken GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM spoken, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
split AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail FROM split, (VALUES (1), (2)) AS places(c) WHERE c < k),
scores AS (SELECT x.lang, x.k, x.phrase, x.a, x.c, l.f AS l, r.f AS r, (1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS score
           FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (
             SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM split WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM split WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
"""
