"""Fuzzy matching of recorded takes to scripted lines, forced alignment and shot segmentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.storage import stored

#: The least score of a match, the weight of containment, and the words of a take that has speech.
LEAST_SCORE, CONTAINED, SPEECH_WORDS = 0.55, 0.9, 4
#: Fixed values of shots: milliseconds between sampled frames, the correlation below which a shot begins, the shortest
#: shot, how near two centers share a position, and the most shots of a track.
SHOT_STEP, CUT_BELOW, LEAST_SHOT, SAME_CENTER, MOST_SHOTS = 250, 0.55, 750, 0.05, 40


def match_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def tokenised(df: DataFrame, key: str) -> DataFrame:
    """key, length, token: a row for each token of a text, and how many tokens the text has; a text without any has a null token."""
    # explode would put a filter on the tokens before it, which finds them twice
    return df.select(key, match_tokens(F.col("text")).alias("ts")).select(key, F.size("ts").alias("length"), F.explode_outer("ts").alias("token"))


def sharing(takes: DataFrame, lines: DataFrame) -> DataFrame:
    """take_id, line_id, vocab, la, lb, common, shared of takes and lines that share a token: the line's distinct tokens, both lengths, and the tokens in both, distinct and repeats counted.

    Only tokens that lines have leave a take, as numbers, and all of one take go to one task; so counting them, meeting the
    lines' and counting again needs no further shuffle, and no row is kept for a token of a pair.
    """
    said = stored(tokenised(lines, "line_id").where("token is not null").groupBy("line_id", "token", "length").agg(F.count("*").alias("line_n")), "lines")
    names = stored(said.select("token").distinct().withColumn("token_no", F.monotonically_increasing_id()), "tokens")
    vocab = said.groupBy("line_id").agg(F.count("*").alias("vocab"))
    b = stored(said.join(names, "token").join(vocab, "line_id").select("line_id", "token_no", "line_n", F.col("length").alias("lb"), "vocab"), "line-tokens")
    met = tokenised(takes, "take_id").join(names, "token").select("take_id", "length", "token_no").repartition("take_id")
    a = met.groupBy("take_id", "token_no", F.col("length").alias("la")).agg(F.count("*").alias("n"))
    shared = [F.sum(F.least("n", "line_n")).alias("shared"), F.count("*").alias("common"), F.first("la").alias("la"), F.first("lb").alias("lb")]
    return a.join(b, "token_no").groupBy("take_id", "line_id", "vocab").agg(*shared)


def reachable(takes: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """take_id, line_id, containment, ratio_bound, bound of pairs whose score can reach `least`."""
    both = sharing(takes, lines).withColumns({"containment": F.col("common") / F.col("vocab"), "ratio_bound": 2.0 * F.col("shared") / (F.col("la") + F.col("lb"))})
    return both.withColumn("bound", F.greatest(CONTAINED * F.col("containment"), "ratio_bound")).where(F.col("bound") >= least).select("take_id", "line_id", "containment", "ratio_bound", "bound")


def bounded_pairs(takes: DataFrame, lines: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """take_id, line_id, containment, bound for pairs whose score can reach `least`.

    containment is the share of a line's distinct tokens that the take has; bound is never below the final score.
    """
    return reachable(takes, lines, least).drop("ratio_bound")


def contained_lines(takes: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """take_id, line_id, containment of pairs that reach a containment."""
    return sharing(takes, lines).select("take_id", "line_id", (F.col("common") / F.col("vocab")).alias("containment")).where(F.col("containment") >= least)


def match_scores(takes: DataFrame, lines: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The larger of the token sequences' ratio and 0.9 times containment, of the pairs that can reach `least`.

    Each row is a take or a line of its own, also where rows repeat an id or have none. A ratio is never above its bound,
    so texts are compared only where the bound is above the other part of the score.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)])

    # numbers of rows are stored, as they are read more than once
    t = stored(takes.select("take_id", "text", F.monotonically_increasing_id().alias("take_no")), "takes")
    x = stored(lines.select("line_id", "text", F.monotonically_increasing_id().alias("line_no")), "lines")
    found = reachable(t.select(F.col("take_no").alias("take_id"), "text"), x.select(F.col("line_no").alias("line_id"), "text"), least)
    pairs = stored(found.withColumnsRenamed({"take_id": "take_no", "line_id": "line_no"}), "pairs")
    contained = CONTAINED * F.col("containment")
    j = pairs.where(F.col("ratio_bound") > contained).join(t.withColumnRenamed("text", "a"), "take_no").join(x.withColumnRenamed("text", "b"), "line_no")
    scores = j.select("take_id", "line_id", F.greatest(ratio(match_tokens(F.col("a")), match_tokens(F.col("b"))), contained).alias("score"))
    named = lambda p: p.join(t.select("take_no", "take_id"), "take_no").join(x.select("line_no", "line_id"), "line_no")
    scores = scores.unionByName(named(pairs.where(F.col("ratio_bound") <= contained)).select("take_id", "line_id", contained.alias("score")))
    if least <= 0:  # pairs without a token in common reach it too
        apart = t.select("take_no").crossJoin(x.select("line_no")).join(pairs.select("take_no", "line_no"), ["take_no", "line_no"], "left_anti")
        scores = scores.unionByName(named(apart).select("take_id", "line_id", F.lit(0.0).alias("score")))
    return scores


def alike(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """(batch, own, class): takes with the same scores for the same lines are one class, and so are lines for takes; told by 128 bits."""
    mark = lambda seed: F.bit_xor(F.xxhash64(other, "score", F.lit(seed)))
    return pairs.groupBy("batch", own).agg(F.struct(mark(1).alias("x"), mark(2).alias("y")).alias(f"{own}_class"))


def blocks_of(pairs: DataFrame) -> DataFrame:
    """Pairs of equal takes and equal lines whose best score is that with each other and with nothing else: the n-th take gets the n-th line."""
    tagged = pairs.join(alike(pairs, "take_id", "line_id"), ["batch", "take_id"]).join(alike(pairs, "line_id", "take_id"), ["batch", "line_id"])
    soles = []
    for own, other in (("take_id_class", "line_id_class"), ("line_id_class", "take_id_class")):
        most = tagged.groupBy("batch", own).agg(F.max("score").alias("score"))
        at = tagged.join(most, ["batch", own, "score"]).groupBy("batch", own, "score").agg(F.min(other).alias(other), F.max(other).alias("other"))
        soles.append(at.where(F.col(other) == F.col("other")).select("batch", own, other, "score"))
    both = soles[0].join(soles[1], ["batch", "take_id_class", "line_id_class", "score"])
    tagged = tagged.join(both, ["batch", "take_id_class", "line_id_class", "score"], "left_semi")
    key = ["batch", "take_id_class", "line_id_class"]
    place = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(c))
    takes = tagged.select(*key, "score", "take_id").distinct().withColumn("place", place("take_id"))
    lines = tagged.select(*key, "line_id").distinct().withColumn("place", place("line_id"))
    return takes.join(lines, [*key, "place"]).select("batch", "take_id", "line_id", "score")


def assign(scores: DataFrame, batch: Column, least: float = LEAST_SCORE) -> DataFrame:
    """One take to one line in each batch, best score first, ties to the smaller ids.

    In rounds: a pair that is the best one left both of its take and of its line is what the greedy choice takes, so all
    such pairs are taken at once, and their takes and lines leave. Equal takes that tie for equal lines are matched
    in one round too, by their ids, which is what the choice comes to for them. No batch is ever in one task.
    """
    left = stored(scores.where(F.col("score") >= least).withColumn("batch", batch), "open")
    rank = F.struct((-F.col("score")).alias("s"), "take_id", "line_id")
    taken: DataFrame | None = None
    while not left.isEmpty():
        per_take = left.groupBy("batch", "take_id").agg(F.min(rank).alias("best"))
        per_line = left.groupBy("batch", "line_id").agg(F.min(rank).alias("best"))
        chosen = per_take.join(per_line.select("batch", "best"), ["batch", "best"]).select("batch", "best.take_id", "best.line_id", (-F.col("best.s")).alias("score"))
        chosen = stored(chosen.unionByName(blocks_of(left)).distinct(), "chosen")
        taken = chosen if taken is None else taken.unionByName(chosen)
        left = stored(left.join(chosen.select("batch", "take_id"), ["batch", "take_id"], "left_anti").join(chosen.select("batch", "line_id"), ["batch", "line_id"], "left_anti"), "open")
    return (taken if taken is not None else left).select("take_id", "line_id", "score", "batch")


def first_sentence(text: Column) -> Column:
    """The text up to its first end of a sentence that white space follows, of at most 120 characters."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.substring(F.regexp_extract(trimmed, r"(?s)^(.*?[.!?](?=\s)|.*)", 1), 1, 120)


def leftovers(takes: DataFrame, assigned: DataFrame, batch: Column, least_words: int = SPEECH_WORDS) -> DataFrame:
    """Takes without a line and with enough words become beats of a new ticket of their batch, in (mtime, id) order."""
    free = takes.join(assigned.select("take_id"), "take_id", "left_anti").where(F.size(match_tokens(F.col("text"))) >= least_words).withColumn("batch", batch)
    place = F.row_number().over(Window.partitionBy("batch").orderBy("mtime", "take_id")) - 1
    return free.select("batch", "take_id", place.cast("long").alias("order_index"))


def aligned(pairs: DataFrame) -> DataFrame:
    """id, k, start, end: times of known words from heard ones, text by text.

    Words are compared by their letters and digits. Equal runs anchor the starts, others are spread between the anchors, from 0
    to the duration; without an anchor all are spread evenly. Times never fall and lie within the duration.
    """

    def one(batches):
        import re
        from difflib import SequenceMatcher

        import numpy as np

        plain = lambda words: [re.sub("[^a-z0-9]", "", w.lower()) for w in words]
        for frame in batches:
            out = []
            for row in frame.itertuples():
                known, n, duration = plain(row.known), len(row.known), max(float(row.duration), 0.1)
                if not n:
                    continue
                at, when = [-1], [0.0]
                for m in SequenceMatcher(None, known, plain(row.heard), autojunk=False).get_matching_blocks():
                    at += range(m.a, m.a + m.size)
                    when += list(row.starts[m.b : m.b + m.size])
                if len(at) == 1:
                    step = duration / n
                    start, end = [round(k * step, 2) for k in range(n)], [round((k + 1) * step, 2) for k in range(n)]
                else:
                    spread = np.interp(np.arange(n + 1), [*at, n], [*when, duration])
                    begin = np.minimum(np.maximum.accumulate(np.maximum(spread[:-1], 0.0)), duration)
                    start, end = begin.round(3), np.minimum(np.maximum(spread[1:], begin + 0.02), duration).round(3)
                out.append(pd.DataFrame({"id": row.id, "k": range(n), "start": start, "end": end}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "k": [], "start": [], "end": []}).astype({"id": "int64", "k": "int64"})

    return pairs.select("id", "known", "heard", "starts", "duration").mapInPandas(one, "id long, k long, start double, end double")


def shot_cuts(frames: DataFrame, below: float = CUT_BELOW, step: int = SHOT_STEP, least: int = LEAST_SHOT) -> DataFrame:
    """track_id, start_ms of each shot: the track's start, and frames unlike the one before, `least` ms or more after the last
    accepted start; a last shot shorter than that belongs to the one before it.

    Frames are `step` ms apart. Of a track's frames only the times of unlike ones are folded, each looked at once.
    """
    w = Window.partitionBy("track_id").orderBy("frame")
    f = frames.withColumns({"prev": F.lag("hist").over(w), "t": (F.row_number().over(w) - 1).cast("long") * step, "end_ms": (F.count("*").over(Window.partitionBy("track_id")) - 1) * step})
    n = F.size("hist")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
    f = f.where("prev is not null").withColumns({"m1": mean(F.col("hist")), "m2": mean(F.col("prev"))})
    dot = lambda a, ma, b, mb: F.aggregate(F.zip_with(a, b, lambda x, y: (x - F.col(ma)) * (y - F.col(mb))), F.lit(0.0), lambda s, x: s + x)
    corr = dot("hist", "m1", "prev", "m2") / F.sqrt(dot("hist", "m1", "hist", "m1") * dot("prev", "m2", "prev", "m2"))
    hits = f.withColumn("corr", corr).where(F.col("corr") < below).select("track_id", "t", "end_ms")

    def accepted(rows):
        rows, taken, begun = rows.sort_by("start_ms"), [], 0
        for k, t in enumerate(rows["start_ms"].to_pylist()):
            if t - begun >= least:
                taken.append(k)
                begun = t
        return rows.take(taken)

    hits = hits.withColumnRenamed("t", "start_ms").select("track_id", "end_ms", "start_ms")
    cuts = hits.groupBy("track_id").applyInArrow(accepted, hits.schema).where("start_ms > 0")
    last = F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("start_ms")).isNull()
    fine = cuts.withColumn("last", last).where(~(F.col("last") & (F.col("end_ms") - F.col("start_ms") < least))).select("track_id", "start_ms")
    return frames.select("track_id", F.lit(0).cast("long").alias("start_ms")).distinct().unionByName(fine)


def folded_shots(shots: DataFrame) -> DataFrame:
    """Shots (track_id, start_ms, center) without those within SAME_CENTER of the last one kept; a fold over one track's shots.

    Of more than MOST_SHOTS the one that moves least goes, the first of equals, until so many are left: a heap of moves
    and links to neighbours, so a track costs n log n.
    """

    def one(shots_):
        import heapq

        shots_ = shots_.sort_by([("start_ms", "ascending"), ("center", "ascending")])
        centers, kept = shots_["center"].to_pylist(), []
        for k, c in enumerate(centers):
            if not kept or not abs(c - centers[kept[-1]]) < SAME_CENTER:
                kept.append(k)
        before, after = dict(zip(kept[1:], kept)), dict(zip(kept, kept[1:]))

        def move(k):
            d = abs(centers[k] - centers[before[k]])
            return (d if d == d else float("inf"), k)

        heap, left = [move(k) for k in kept[1:]], set(kept)
        heapq.heapify(heap)
        while len(left) > MOST_SHOTS:
            d, k = heapq.heappop(heap)
            if k not in left or d != move(k)[0]:
                continue  # gone, or its move has changed since
            left.remove(k)
            if k in after:
                before[after[k]] = before[k]
                heapq.heappush(heap, move(after[k]))
            after[before[k]] = after.get(k)
            if after[before[k]] is None:
                del after[before[k]]
        return shots_.take(sorted(left))

    center = F.round(F.coalesce("center", F.lit(0.5)), 4)
    rows = shots.select("track_id", "start_ms", center.alias("center"))
    return rows.groupBy("track_id").applyInArrow(one, rows.schema)
