"""Timed transcripts: words to sentences, sentences to candidate moments, and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import intervals
from cadenza.storage import stored

# Words that are cut as fillers.
FILLERS = ["um", "umm", "uhm", "uh", "uhh", "er", "erm", "ah", "ahh", "hmm", "hm", "mhm", "mm", "mmm"]
# The scorer's lexicons. Openers are phrases at a sentence's start, as a pattern.
OPENERS = (
    "why|how|what|when|who|which|where|imagine|stop|never|here'?s|here is|listen|the truth|truth is|nobody|no one|most people|everyone|everybody|if you|you need|"
    "you have to|you should|the (biggest|best|worst|only|one|real|secret)|secret|mistake|i (was|got|never|had|lost|quit|failed|learned|realized|realised|made)|let me tell you|"
    "this is (why|how|what)|there'?s (one|a) thing"
)
EMOTION = (
    "love loved hate hated fear afraid scared terrified died death dying fired failed failure fail success successful money rich poor broke free truth lie lied lies "
    "secret secrets mistake mistakes crazy insane wild amazing incredible terrible awful best worst biggest hardest pain painful dream dreams hope lost win won lose losing "
    "shocked shocking honest honestly regret proud cry cried angry furious happy happiest miracle dangerous warning nobody everything nothing forever never"
).split()
CONTRAST = ["but", "actually", "instead", "however", "except", "until", "because", "yet"]
SECOND = ["you", "your", "you're", "yourself", "you'll", "you've"]
NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|hundred|thousand|million|billion|percent|half|double|triple"
SMALL_WORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "as", "by", "from"]
# Lengths of clips in milliseconds, and what a reason says.
MIN_MS, MAX_MS, TARGETS = 15_000, 60_000, (30_000, 50_000)
SIGNALS = ["opens with a question", "strong opening line", "a number up front", "emotional opening", "emotional language", "mentions a number", "talks to the viewer", "good pace", "punchy sentences"]
NO_SPEECH = "no speech was found in this video, so there are no moments to pick from"

NOT_WORD = r"[^\p{L}\p{N}_]"
OPENS = f"(?i)^{NOT_WORD}*({OPENERS})({NOT_WORD}|$)"
NUMBER = f"(?i)(\\p{{Nd}}|(^|{NOT_WORD})({NUMBERS})({NOT_WORD}|$))"


#: What tells one transcript from another; chunks of a transcript have a second column. Rows dealt out by project lie by both.
KEY, CHUNK = ("project_id",), ("project_id", "chunk_start")


def by_project(key: tuple[str, ...] = KEY) -> Window:
    return Window.partitionBy(*key).orderBy("idx")


def ends_sentence(word: Column) -> Column:
    return F.substring(word, -1, 1).isin(".", "!", "?")


def normal(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9']", "")


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """A piece that begins with a hyphen joins the word before it, if there is one.

    A word's first piece looks over the pieces that have its number, few as a rule, so the many words of one piece aren't grouped.
    """
    w = by_project()
    own = ~F.startswith("word", F.lit("-"))
    begins = own | (F.row_number().over(w) == 1)
    x = pieces.withColumns({"g": F.coalesce(F.sum(own.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "begins": begins})
    same = Window.partitionBy("project_id").orderBy("g").rangeBetween(Window.currentRow, Window.currentRow)
    seen = {"parts": F.collect_list(F.when(~F.col("begins"), F.struct("idx", "word"))), "from": F.min("start_ms"), "upto": F.max("end_ms")}
    x = x.withColumns({k: v.over(same) for k, v in seen.items()}).where("begins")
    word = F.concat(F.coalesce("word", F.lit("")), F.array_join(F.transform(F.sort_array("parts"), lambda x: x["word"]), ""))
    return x.select("project_id", "idx", word.alias("word"), F.col("from").alias("start_ms"), F.col("upto").alias("end_ms"))


def pause(longer: int = 1000, keep: int = 150, least: int = 200) -> Column:
    """struct(a, b) of the pause after a word, null where there is none; `nxt` is when the next word begins."""
    a, b = F.col("end_ms") + keep, F.col("nxt") - keep
    return F.when((F.col("nxt") - F.col("end_ms") > longer) & (b - a >= least), F.struct(a.alias("a"), b.alias("b")))


def filler(pad: int = 30, fillers: list[str] = FILLERS) -> Column:
    """struct(a, b) of a filler, padded and kept inside the project's time, null for other words; cuts under 50 ms go."""
    a, b = F.greatest(F.col("start_ms") - pad, F.lit(0)), F.least(F.col("end_ms") + pad, "last_ms")
    return F.when(F.regexp_replace(F.lower("word"), "[^a-z']", "").isin(fillers) & (b - a >= 50), F.struct(a.alias("a"), b.alias("b")))


def cuts_of(words: DataFrame, *found: Column) -> DataFrame:
    """project_id, a, b: what is found at each word, in one pass; `nxt` and `last_ms` are the next word's start and the project's end."""
    w = by_project()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = words.withColumns({"nxt": F.lead("start_ms").over(w), "last_ms": F.max("end_ms").over(whole)})
    return x.select("project_id", F.inline(F.array(*found))).where("a is not null")


def pause_cuts(words: DataFrame, longer: int = 1000, keep: int = 150, least: int = 200) -> DataFrame:
    return cuts_of(words, pause(longer, keep, least))


def filler_cuts(words: DataFrame, pad: int = 30, fillers: list[str] = FILLERS) -> DataFrame:
    """Fillers, padded and kept inside the project's time; cuts under 50 ms go."""
    return cuts_of(words, filler(pad, fillers))


def cuts(words: DataFrame) -> DataFrame:
    """Pauses and fillers."""
    return cuts_of(words, pause(), filler())


def kept_segments(words: DataFrame) -> DataFrame:
    """What is left of each project's time without its pauses and fillers, with `base`; the project's end comes with its last word, so words are read once."""
    bounds = [F.lit(0).cast("long").alias("lo"), F.col("last_ms").alias("hi")]
    inside = lambda x: F.when(x.isNotNull(), F.struct(x["a"].alias("a"), x["b"].alias("b"), *bounds))
    end = F.when(F.col("nxt").isNull(), F.struct(F.col("last_ms").alias("a"), F.col("last_ms").alias("b"), *bounds))
    return intervals.gaps(cuts_of(words, inside(pause()), inside(filler()), end))


def sentences(words: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """project_id, sid, start_ms, end_ms, text, n. A project with enough terminal marks breaks at them and at pauses over
    1.2 s, another after 14 words and at pauses over 0.6 s."""
    return sentences_with_edges(words, key).drop("starts", "ends_at")


def sentences_with_edges(words: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Sentences with their words' starts and ends, so words needn't be read or shuffled again for them.

    An edge is one number: twice its time, and one more for a start that opens a sentence or an end that closes one.
    """
    # all windows have the one order, so words are sorted once
    w = by_project(key)
    whole, earlier = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    terminal = ends_sentence(F.col("word"))
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    edges = {"starts": F.col("start_ms") * 2 + flag(F.lag(terminal).over(w)), "ends_at": F.col("end_ms") * 2 + flag(terminal)}
    seen = {"gap": F.lead("start_ms").over(w) - F.col("end_ms"), "marks": F.sum(terminal.cast("int")).over(whole), "total": F.count("*").over(whole), "place": F.row_number().over(w)}
    f = words.select(*key, "idx", "word", "start_ms", "end_ms").withColumns(seen | edges)
    punctuated = F.col("marks") >= F.greatest(F.lit(3), F.floor(F.col("total") / 40))
    breaks = F.when(punctuated, terminal | (F.col("gap") > 1200)).otherwise(F.col("gap") > 600)
    f = f.withColumns({"punctuated": punctuated, "breaks": F.coalesce(breaks.cast("int"), F.lit(0))})
    since = F.coalesce(F.max(F.when(F.col("breaks") == 1, F.col("place"))).over(earlier), F.lit(0))
    f = f.withColumns({"island": F.coalesce(F.sum("breaks").over(earlier), F.lit(0)), "since": since})
    f = f.withColumn("chunk", F.when(F.col("punctuated"), 0).otherwise(F.floor((F.col("place") - F.col("since") - 1) / 14)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    g = f.groupBy(*key, "island", "chunk").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"), F.count("*").alias("n"), *[F.collect_list(c).alias(c) for c in edges])
    sid = F.row_number().over(Window.partitionBy(*key).orderBy("island", "chunk")) - 1
    return g.select(*key, sid.cast("long").alias("sid"), "start_ms", "end_ms", "text", "n", *edges)


def spans(sents: DataFrame, key: tuple[str, ...] = KEY, last: tuple[str, ...] = ()) -> DataFrame:
    """Sentences with `i`, `from_ms` and `found`: for each target the last sentence (j, end_ms and its `last` columns) that brings the length nearest it.

    A sentence stands at its start as a first one and at its end as a last one, and a first one looks at the ends between the
    least and the longest clip after it: one window, no join. A project without any candidate gives one clip of the whole.
    """
    own = F.struct(*[c for c in sents.columns if c not in key])
    end = F.struct(F.col("sid").alias("j"), "end_ms", *last)
    null = lambda c: F.when(F.lit(False), c)
    place = lambda at, x, y: F.struct(F.col(at).cast("long").alias("at"), x.alias("own"), y.alias("end"))
    rows = sents.select(*key, F.inline(F.array(place("start_ms", own, null(end)), place("end_ms", null(own), end))))
    near = Window.partitionBy(*key).orderBy("at").rangeBetween(MIN_MS, MAX_MS)
    x = rows.withColumn("near", F.collect_list("end").over(near)).where("own is not null").select(*key, "own.*", "near")
    x = x.withColumn("near", F.filter("near", lambda e: e["j"] >= F.col("sid")))
    off = lambda t: lambda e: F.struct(F.abs(e["end_ms"] - F.col("start_ms") - t).alias("off"), e["j"].alias("j"), e.alias("e"))
    best = [F.array_min(F.transform("near", off(t)))["e"] for t in TARGETS]
    x = x.withColumn("found", F.array_distinct(F.array_compact(F.array(*best)))).drop("near")
    whole = Window.partitionBy(*key)
    all_ = F.struct(F.max("sid").over(whole).alias("j"), F.max("end_ms").over(whole).alias("end_ms"), *[F.max_by(c, "sid").over(whole).alias(c) for c in last])
    x = x.withColumns({"any": F.max(F.size("found")).over(whole) > 0, "first_sid": F.min("sid").over(whole), "first_start": F.min("start_ms").over(whole), "all": all_})
    some = F.when(F.col("any") | (F.col("sid") > F.col("first_sid")), F.col("found")).otherwise(F.array("all"))
    x = x.withColumns({"found": some, "i": F.when(F.col("any"), F.col("sid")).otherwise(0), "from_ms": F.when(F.col("any"), F.col("start_ms")).otherwise(F.col("first_start"))})
    return x.drop("any", "first_sid", "first_start", "all")


def candidates(sents: DataFrame) -> DataFrame:
    """project_id, i, j, start_ms, end_ms: for each first sentence the last one that brings the length nearest each target. They are stored, as they are read more than once."""
    x = spans(sents.select("project_id", "sid", "start_ms", "end_ms"))
    return stored(x.select("project_id", "i", F.col("from_ms").alias("start_ms"), F.inline("found")).select("project_id", "i", "j", "start_ms", "end_ms"), "candidates")


def tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, " "), normal), lambda t: t != "")


def count_in(toks: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(lexicon))).cast("long")


#: What is counted in a sentence.
COUNTED = ("emo", "you", "contrast", "nums", "short", "toks_n")


def sentence_numbers(sents: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Sentences with counts, their running sums (c_), hook and what it comes from, and the project's first and last time."""
    t = F.col("toks")
    w = Window.partitionBy(*key).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    counts = [count_in(t, EMOTION), count_in(t, SECOND), count_in(t, CONTRAST), F.col("text").rlike(NUMBER).cast("long"), (F.col("n") <= 12).cast("long"), F.size(t).cast("long")]
    s = sents.withColumn("toks", tokens(F.col("text"))).withColumns(dict(zip(COUNTED, counts, strict=True))).drop("toks")
    asks, opens = F.col("text").endswith("?"), F.col("text").rlike(OPENS)
    s = s.withColumns({"asks": asks, "opens": opens, "ends": F.col("text").rlike("[.!?]$")})
    hook = F.least(F.lit(100), 45 * F.col("asks").cast("int") + 35 * F.col("opens").cast("int") + 15 * F.col("nums") + 20 * (F.col("emo") > 0).cast("int") + 10 * (F.col("you") > 0).cast("int")) / 100.0
    whole = Window.partitionBy(*key)
    return s.withColumns({f"c_{k}": F.sum(k).over(w) for k in COUNTED} | {"hook": hook, "last_ms": F.max("end_ms").over(whole), "first_ms": F.min("start_ms").over(whole)})


def features(sents: DataFrame, cands: DataFrame) -> DataFrame:
    """Adds hook, body, rhythm, punch, complete, quality and reason to candidates.

    Every sentence is scored once and its numbers stored; a candidate's numbers are differences of running sums.
    """
    s = stored(sentence_numbers(sents).select("project_id", "sid", *COUNTED, *[f"c_{k}" for k in COUNTED], "hook", "asks", "opens", "ends", "first_ms", "last_ms"), "scored-sentences")
    first = s.select("project_id", F.col("sid").alias("i"), "hook", "asks", "opens", "first_ms", "last_ms", *COUNTED, *[f"c_{k}" for k in COUNTED])
    last = s.select("project_id", F.col("sid").alias("j"), "ends", *[F.col(f"c_{k}").alias(f"b_{k}") for k in COUNTED])
    return rated(cands.join(first, ["project_id", "i"]).join(last, ["project_id", "j"])).select("project_id", *RATED)


#: A scored candidate's columns.
RATED = ("i", "j", "start_ms", "end_ms", "hook", "body", "rhythm", "punch", "complete", "quality", "reason")


def rated(c: DataFrame) -> DataFrame:
    """Adds RATED to candidates (i, j, start_ms, end_ms) with the numbers of their first sentence, and `ends` and the sums (b_) of their last."""
    n = {k: F.col(f"b_{k}") - (F.col(f"c_{k}") - F.col(k)) for k in COUNTED}
    moved, counted = F.col("emo") > 0, F.col("nums") > 0
    total, sentences_n = F.greatest(n["toks_n"], F.lit(1)), F.col("j") - F.col("i") + 1
    later, viewer = (n["nums"] > 0) & ~counted, n["you"] * 100 > total * 3
    body = F.least(F.lit(1.0), F.least(F.lit(1.0), 25.0 * n["emo"] / total) + F.when(later, 0.2).otherwise(0.0))
    body = F.least(F.lit(1.0), body + F.when(n["contrast"] > 0, 0.1).otherwise(0.0))
    body = F.least(F.lit(1.0), body + F.when(viewer, 0.15).otherwise(0.0))
    wps = total * 1000.0 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(100))
    rhythm = F.when(wps.between(2.0, 3.6), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(wps - 2.8) / 2.8))
    punch = n["short"] / sentences_n
    signs = [F.col("asks"), F.col("opens"), counted, moved, (n["emo"] >= 2) & ~moved, later, viewer, F.col("rhythm") >= 0.9, (F.col("punch") >= 0.5) & (sentences_n >= 2)]
    said = F.slice(F.array_compact(F.array(*[F.when(x, v) for x, v in zip(signs, SIGNALS, strict=True)])), 1, 4)
    whole_clip = F.concat(F.lit("Built-in finder: "), F.array_join(said, ", "), F.lit("."))
    alone = ~(F.col("end_ms") - F.col("start_ms")).between(MIN_MS, MAX_MS)  # only a project without any candidate has such a clip
    reason = F.when(alone, "Built-in finder: the whole video (shorter than one clip).").when(F.size(said) > 0, whole_clip).otherwise("Built-in finder: a complete thought at a natural pace.")
    out = c.withColumns({"body": body, "rhythm": rhythm, "punch": punch, "complete": F.when(F.col("ends"), 1.0).otherwise(0.6)})
    q = 0.4 * F.col("hook") + 0.25 * F.col("body") + 0.15 * F.col("rhythm") + 0.1 * F.col("punch") + 0.1 * F.col("complete")
    span = F.greatest(F.col("last_ms") - F.col("first_ms"), F.lit(1000))
    q = q - F.when((F.col("start_ms") - F.col("first_ms")) * 100 < span * 3, 0.15).when((F.col("end_ms") - F.col("first_ms")) * 100 > span * 97, 0.08).otherwise(0.0)
    return out.withColumns({"quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), "reason": reason})


def scored_words(words: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Scored candidates of words (is_point 1, RATED and their first sentence's text) and for each sentence a row of its words' edges (is_point 0).

    Words that lie by project are read once, and neither they nor sentences nor candidates are shuffled or stored.
    """
    sums = tuple(f"c_{k}" for k in COUNTED)
    s = spans(sentence_numbers(sentences_with_edges(words, key), key), key, ("ends", *sums))
    point = lambda e: F.struct(F.lit(1).alias("is_point"), e["j"].alias("j"), F.col("from_ms").alias("start_ms"), e["end_ms"].alias("end_ms"), e["ends"].alias("ends"), *[e[c].alias(f"b{c[1:]}") for c in sums])
    no = F.lit(None)
    edges = F.struct(F.lit(0).alias("is_point"), no.cast("long").alias("j"), no.cast("long").alias("start_ms"), no.cast("long").alias("end_ms"), no.cast("boolean").alias("ends"), *[no.cast("long").alias(f"b{c[1:]}") for c in sums])
    c = s.select(*key, "i", "text", "hook", "asks", "opens", "first_ms", "last_ms", *COUNTED, *sums, "starts", "ends_at", F.inline(F.concat(F.array(edges), F.transform("found", point))))
    only = lambda c: F.when(F.col("is_point") == 0, F.col(c)).alias(c)
    return rated(c).select(*key, "is_point", *RATED, "text", only("starts"), only("ends_at"))


#: The marks that a title's words lose at their ends.
MARKS = "\"'.,!?;:()\\[\\]"


def title_of(text: Column) -> Column:
    """A title from a sentence's first six words: marks at their ends stripped, small words kept low after the first."""
    # one replacement for a text, not one for each word
    bare = F.regexp_replace(text, rf"(?<!\S)[{MARKS}]+|[{MARKS}]+(?!\S)", "")
    words = F.slice(F.filter(F.split(bare, r"\s+"), lambda x: x != ""), 1, 6)
    shouted = lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)
    cased = lambda x, k: F.when(shouted(x), x).when((k > 0) & F.lower(x).isin(SMALL_WORDS), F.lower(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    # a pattern fills an empty title, as a condition would work the title out twice
    return F.regexp_replace(F.array_join(F.transform(words, cased), " "), "^$", "Untitled moment")


def titles(sents: DataFrame) -> DataFrame:
    return sents.select("project_id", "sid", title_of(F.col("text")).alias("title"), F.substring("text", 1, 200).alias("hook_sentence"))


def overlap(a, b) -> Column:
    return F.greatest(F.lit(0), F.least(a["end_ms"], b["end_ms"]) - F.greatest(a["start_ms"], b["start_ms"]))


def greedy(moments: DataFrame, by: str, clashes, most: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per project the moments accepted in order, the largest `by` first, each clashing with none accepted before.

    A fold over one project's candidates, which are a few thousand where transcripts are cut into chunks.
    """
    rest = [c for c in moments.columns if c not in (*key, "start_ms", "end_ms", by)]
    row = F.struct((-F.col(by)).alias("o"), "start_ms", "end_ms", by, *rest)
    per = moments.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("all"))
    # never empty; inline would put a filter before it, which folds twice
    return per.select(*key, F.inline_outer(accepted(per, clashes, most))).drop("o")


def accepted(per: DataFrame, clashes, most: int) -> Column:
    """Of the moments in `all`, in order, those that clash with none accepted before, by their starts."""
    none = F.array().cast(per.schema["all"].dataType)
    fold = F.aggregate("all", none, lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: clashes(x, k)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(fold, lambda x, y: F.when(x["start_ms"] < y["start_ms"], -1).when(x["start_ms"] > y["start_ms"], 1).otherwise(0))


def covers(x, k) -> Column:
    """Whether k overlaps x by over a quarter of x's length."""
    return overlap(x, k) * 4 > x["end_ms"] - x["start_ms"]


def pick_moments(moments: DataFrame, n: int = 6) -> DataFrame:
    """Best quality first; a candidate may overlap an accepted one by a quarter of its own length at most."""
    return greedy(moments, "quality", covers, n)


def dedupe_moments(moments: DataFrame, by: str = "quality", key: tuple[str, ...] = KEY) -> DataFrame:
    """Best first; one that overlaps a kept one by over half of the shorter goes."""
    shorter = lambda x, k: F.least(x["end_ms"] - x["start_ms"], k["end_ms"] - k["start_ms"])
    return greedy(moments, by, lambda x, k: (shorter(x, k) > 0) & (overlap(x, k) * 2 > shorter(x, k)), 1 << 30, key)


def chunked(words: DataFrame, long_ms: int = 1_440_000, size: int = 1_200_000, step: int = 1_140_000) -> DataFrame:
    """Words with chunk_start: a long transcript's words fall into windows that overlap, other transcripts are one chunk.

    A word lies in one window or in two that overlap; both numbers follow from its time, without a join.
    """
    w = Window.partitionBy("project_id")
    spans = words.withColumns({"t0": F.min("start_ms").over(w), "t1": F.max("end_ms").over(w)})
    since = F.col("start_ms") - F.col("t0")
    lo = F.greatest(F.floor((since - size) / step) + 1, F.lit(0))
    hi = F.least(F.floor((since + 10) / step), F.ceil((F.col("t1") - F.col("t0")) / step) - 1)
    numbers = F.when(F.col("t1") - F.col("t0") <= long_ms, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(lo, F.greatest(lo, hi)))
    return spans.withColumn("k", F.explode(numbers)).withColumn("chunk_start", F.col("t0") + F.col("k") * step).drop("t0", "t1", "k")


def chunks(words: DataFrame, **sizes: int) -> DataFrame:
    """A long transcript's windows: project_id, chunk_start, n words; others are one chunk."""
    return chunked(words, **sizes).groupBy("project_id", "chunk_start").agg(F.count("*").alias("n"))


def normalised(clips: DataFrame, words: DataFrame, within: int = 3000) -> DataFrame:
    """Clips moved to sentence boundaries under 3 s away, else to the nearest word's, kept inside the video and between the
    least and the longest length, with each changed end moved to a boundary again; clips under 3 s go.

    All lookups are windows over one union of words and clips: one shuffle by project. A boundary at 0 counts as none.
    """
    w = by_project()
    ends = ends_sentence(F.col("word"))
    opens = F.coalesce(F.lag(ends).over(w), F.lit(False))
    rest = F.struct(*[c for c in clips.columns if c not in ("project_id", "start_ms", "end_ms")])
    times = [F.col(c).cast("long") for c in ("start_ms", "end_ms")]
    marks = words.select("project_id", word_mark(*times, opens, ends, null_of(clips, rest)).alias("r"))
    u = marks.unionByName(clips.select("project_id", clip_point(*times, rest).alias("r"))).select("project_id", "r.*")
    return at_boundaries(u, within=within)


def null_of(df: DataFrame, c: Column) -> Column:
    return F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)


def word_mark(start: Column, end: Column, opens: Column, ends: Column, rest: Column) -> Column:
    """A word as at_boundaries reads it; `rest` is a null of the clips' other columns."""
    return F.struct(F.lit(0).alias("is_point"), start.alias("s_word"), end.alias("e_word"), F.when(opens, start).alias("s_sent"), F.when(ends, end).alias("e_sent"), rest.alias("rest"))


def clip_point(start: Column, end: Column, rest: Column) -> Column:
    """A clip as at_boundaries reads it, its times where a word has its own."""
    no = F.lit(None).cast("long")
    return F.struct(F.lit(1).alias("is_point"), start.alias("s_word"), end.alias("e_word"), no.alias("s_sent"), no.alias("e_sent"), rest.alias("rest"))


def edge_marks(starts: Column, ends_at: Column, rest: Column) -> Column:
    """Marks of words whose edges sentences_with_edges has packed."""
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    return F.zip_with(starts, ends_at, lambda a, z: word_mark(F.shiftright(a, 1), F.shiftright(z, 1), odd(a), odd(z), rest))


def at_boundaries(rows: DataFrame, key: tuple[str, ...] = KEY, within: int = 3000) -> DataFrame:
    """What `normalised` says, over rows of words' marks and of clips."""
    point = F.col("is_point") == 1
    whole = Window.partitionBy(*key)
    u = rows.where("is_point = 0 or e_word > s_word").withColumns({"x": F.when(point, F.col("s_word")), "y": F.when(point, F.col("e_word"))})
    u = u.withColumns({c: F.when(~point, F.col(c)) for c in ("s_word", "e_word")})
    u = u.withColumns({"v0": F.min("s_word").over(whole), "v1": F.max("e_word").over(whole)})

    def snapped(df: DataFrame, target: str, side: str) -> DataFrame:
        at = F.when(F.col("is_point") == 1, F.col(target)).otherwise(F.col(f"{side}_word"))
        df = df.withColumn("at", at)
        s0, s1 = intervals.around(f"{side}_sent", "at", list(key))
        w0, w1 = intervals.around(f"{side}_word", "at", list(key))
        df = df.withColumns({"s0": s0, "s1": s1, "w0": w0, "w1": w1})
        sent, word = intervals.nearest(F.col("at"), F.col("s0"), F.col("s1")), intervals.nearest(F.col("at"), F.col("w0"), F.col("w1"))
        found = F.coalesce(F.when((F.abs(sent - F.col("at")) < within) & (sent != 0), sent), word)
        return df.withColumn(target, F.when(F.col("is_point") == 1, found)).drop("at", "s0", "s1", "w0", "w1")

    u = snapped(u, "x", "s").withColumn("x", F.greatest("x", "v0"))
    u = snapped(u, "y", "e").withColumn("y", F.least("y", "v1"))
    u = snapped(u.withColumn("z", F.least(F.col("v1"), F.col("x") + MIN_MS)), "z", "e")
    u = u.withColumn("y", F.when(F.col("y") - F.col("x") < MIN_MS, F.col("z")).otherwise(F.col("y")))
    u = snapped(u.withColumn("z", F.col("x") + MAX_MS), "z", "e")
    u = u.withColumn("y", F.least(F.when(F.col("y") - F.col("x") > MAX_MS, F.col("z")).otherwise(F.col("y")), F.col("v1")))
    return u.where("is_point = 1 and y - x >= 3000").select(*key, F.col("x").alias("start_ms"), F.col("y").alias("end_ms"), "rest.*")


def normalised_candidates(words: DataFrame) -> DataFrame:
    """All scored candidates of words at their boundaries, with quality, i and j."""
    c = scored_words(words)
    rest = F.struct("quality", "i", "j")
    rows = F.when(F.col("is_point") == 0, edge_marks(F.col("starts"), F.col("ends_at"), null_of(c, rest))).otherwise(F.array(clip_point(F.col("start_ms"), F.col("end_ms"), rest)))
    return at_boundaries(c.select("project_id", F.inline(rows)))


def find_moments(pieces: DataFrame, n: int = 6) -> DataFrame:
    """The whole finder: word pieces merged, long transcripts cut into chunks, and in each chunk sentences, candidates, scores,
    a choice without overlap, boundaries and no near repeats; then no near repeats across chunks.

    Projects without words have no rows here; see without_speech. Chunks have a column of their own beside the project, so
    words that lie by project aren't shuffled at any step, and nothing is stored.
    """
    c = scored_words(chunked(merge_pieces(pieces)), CHUNK)
    row = F.struct((-F.col("quality")).alias("o"), "start_ms", "end_ms", "quality", "i", "j", "reason", "text")
    own = F.when(F.col("is_point") == 1, row)
    edges = [F.flatten(F.collect_list(x)).alias(x) for x in ("starts", "ends_at")]
    per = c.groupBy(*CHUNK).agg(F.sort_array(F.collect_list(own)).alias("all"), *edges)
    per = per.select(*CHUNK, "starts", "ends_at", accepted(per, covers, n).alias("chosen"))
    score = lambda x: F.bround(55 + 40 * x["quality"], 1)
    rest = lambda x: F.struct(score(x).alias("score"), x["reason"].alias("reason"), x["text"].alias("text"))
    points = F.transform("chosen", lambda x: clip_point(x["start_ms"], x["end_ms"], rest(x)))
    u = per.select(*CHUNK, F.inline(F.concat(points, edge_marks(F.col("starts"), F.col("ends_at"), null_of(per, rest(F.col("chosen")[0]))))))
    clips = at_boundaries(u, CHUNK)
    clips = clips.withColumns({"title": title_of(F.col("text")), "hook_sentence": F.substring("text", 1, 200)}).drop("text")
    own = dedupe_moments(clips, "score", CHUNK).drop("chunk_start")
    cut = [F.substring("title", 1, 120).alias("title"), F.col("hook_sentence").alias("hook"), F.substring("reason", 1, 300).alias("reason")]
    seconds = [F.bround(F.col(f"{c}_ms") / 1000, 2).alias(c) for c in ("start", "end")]
    return dedupe_moments(own, "score").select("project_id", "start_ms", "end_ms", *seconds, "score", *cut)


def without_speech(projects: DataFrame, words: DataFrame) -> DataFrame:
    """Projects without a word, with the error that the finder gives for them."""
    return projects.join(words.select(F.col("project_id").alias("id")), "id", "left_anti").select("id", F.lit(NO_SPEECH).alias("error"))


#: Finders by name; each takes word pieces and a number and gives moments. Others may be added.
FINDERS = {"heuristic": find_moments}


def stamped(words: DataFrame, every: int = 8) -> DataFrame:
    """The text with the time in seconds, to one place, before every eighth word."""
    piece = F.when(F.col("idx") % every == 0, F.concat(F.format_string("[t=%.1f] ", F.col("start_ms") / 1000.0), F.trim("word"))).otherwise(F.trim("word"))
    return words.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", piece.alias("w")))), lambda x: x["w"]), " ").alias("text"))


def lined(words: DataFrame, most: int = 4) -> DataFrame:
    """Words with seg and part, which tell caption lines: of at most `most` words, ending also where a sentence does.

    Both windows have the one order, so words are sorted once.
    """
    w = by_project()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends_sentence(F.col("word"))
    seg = words.withColumns({"seg": F.coalesce(F.sum(ends.cast("int")).over(earlier), F.lit(0)), "place": F.row_number().over(w)})
    rn = F.col("place") - F.coalesce(F.max(F.when(ends, F.col("place"))).over(earlier), F.lit(0)) - 1
    return seg.withColumn("rn", rn).withColumn("part", F.floor(F.col("rn") / most)).drop("place", "rn")


def line_values(words: DataFrame, value: str, most: int = 4) -> DataFrame:
    """project_id, first_idx and the values of each caption line's words in order; a line's first word looks ahead, so nothing is grouped."""
    w = by_project()
    x = lined(words, most)
    begins = F.coalesce((F.lag("seg").over(w) != F.col("seg")) | (F.lag("part").over(w) != F.col("part")), F.lit(True))
    # from a line's first word, the next ones of its segment are its own up to the most
    own = [F.struct(F.col(value).alias("v")), *[F.when(F.lead("seg", k).over(w) == F.col("seg"), F.struct(F.lead(value, k).over(w).alias("v"))) for k in range(1, most)]]
    return x.select("project_id", F.col("idx").alias("first_idx"), F.array(*own).alias("own"), begins.alias("begins")).where("begins").select("project_id", "first_idx", F.transform(F.array_compact("own"), lambda x: x["v"]).alias("values"))


def caption_lines(words: DataFrame, most: int = 4) -> DataFrame:
    g = lined(words, most).groupBy("project_id", "seg", "part").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return g.drop("seg", "part")


def caption_events(words: DataFrame, most: int = 4) -> DataFrame:
    """An event for each word of its line: from its start to its end, 50 ms at least."""
    line = Window.partitionBy("project_id", "seg", "part")
    start = F.greatest(F.col("start_ms"), F.lit(0))
    return lined(words, most).select("project_id", "idx", F.min("idx").over(line).alias("first_idx"), start.alias("start_ms"), F.greatest(F.col("end_ms"), start + 50).alias("event_end"))
