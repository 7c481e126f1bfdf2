"""Assignment and leftovers against brute force over takes that compete for lines."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cadenza.operators import matching
from cadenza.plans import registry

LINES = [(1, "show the desk before you start"), (2, "count every euro you spend"), (3, "alpha beta gamma delta epsilon zeta eta theta")]
TAKES = [
    (10, "show the desk before you start"),
    (20, "show the desk before you start now"),  # its line goes to take 10
    (30, "so show the desk before you start"),
    (40, "start you before desk the show"),  # every word of the line, but in another order: 0.9
    (50, "nothing of that kind was said here"),
    (60, "show the desk"),  # too short for a beat
    (70, "theta eta zeta epsilon delta gamma nothing else"),  # a bound of 0.75 and a score of 0.675
    (80, "epsilon delta gamma beta alpha one two"),  # a bound of 0.67 and a score of 0.5625
    (90, "delta gamma beta alpha one"),  # a bound of 0.62, a score under 0.55
    (11, "count every euro you spend"),
    (21, "every euro you spend we count"),
]


def brute(takes, lines):
    tokens = lambda t: [w for w in re.sub("[^a-z0-9' ]", " ", t.lower()).split(" ") if w]
    scored = []
    for take, text in takes:
        for line, said in lines:
            a, b = tokens(text), tokens(said)
            score = max(SequenceMatcher(None, a, b).ratio(), 0.9 * len(set(a) & set(b)) / len(set(b)))
            scored.append((-score, take, line))
    taken, given = set(), set()
    for score, take, line in sorted(scored):
        if -score >= 0.55 and take not in taken and (take % 10, line) not in given:
            taken.add(take)
            given.add((take % 10, line))
    out = {}
    for take, text in sorted(takes, key=lambda r: (len(r[1]), r[0])):
        if take not in taken and len(tokens(text)) >= 4:
            batch = out.setdefault(take % 10, [])
            batch.append((take % 10, take, len(batch)))
    return taken, sorted(r for batch in out.values() for r in batch)


def given(spark, tmp_path):
    docs = [(i, t, "en", "web", len(t)) for i, t in TAKES]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LINES, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_take_is_assigned_or_left_over(spark, tmp_path):
    sf = given(spark, tmp_path)
    taken, left = brute(TAKES, LINES)
    found = sorted(tuple(r) for r in registry.queries()["leftover_beats"](spark, sf).select("batch", "take_id", "order_index").collect())
    assert found == left and len(left) > 4
    assert {r.take_id for r in registry.queries()["assign_takes"](spark, sf).collect()} == taken


def greedy(rows):
    takes, lines, out = set(), set(), set()
    for score, take, line, batch in sorted((-s, t, x, b) for t, x, s, b in rows):
        if (batch, take) not in takes and (batch, line) not in lines:
            takes.add((batch, take))
            lines.add((batch, line))
            out.add((take, line, -score, batch))
    return out


def rounds_of(spark, monkeypatch, rows):
    made = []
    real = matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: made.append(name) or real(df, name))
    got = {tuple(r) for r in matching.assign(spark.createDataFrame(rows, "take_id long, line_id long, score double, batch long"), F.col("batch")).collect()}
    return got, made.count("chosen")


@pytest.mark.parametrize(("takes", "lines"), [(15, 15), (40, 7), (7, 40)])
def test_equal_takes_and_lines_in_one_round(spark, monkeypatch, takes, lines):
    rows = [(t, 100 + x, 0.9, 1) for t in range(takes) for x in range(lines)] + [(t, 200, 0.7, 1) for t in range(takes)]
    got, rounds = rounds_of(spark, monkeypatch, rows)
    assert got == greedy(rows) and rounds <= 2


@pytest.mark.parametrize("seed", range(3))
def test_ties_as_the_greedy_choice(spark, monkeypatch, seed):
    """Few scores, and copies of takes and of lines, so blocks of equals meet each other."""
    rng = random.Random(seed)
    kinds = {(a, b): rng.choice([0.5, 0.6, 0.6, 0.8, 0.8, None]) for a in range(5) for b in range(5)}
    rows = [(t, 100 + x, kinds[t % 5, x % 5], b) for b in (1, 2) for t in range(13) for x in range(11) if kinds[t % 5, x % 5] and (t + b) % 7]
    got, _ = rounds_of(spark, monkeypatch, rows)
    assert got == greedy([r for r in rows if r[2] >= 0.55])


def test_no_row_is_shuffled_for_a_token_of_a_pair(spark):
    """Every take shares common words with every line: what is shuffled are the takes' tokens, in one exchange by take."""
    takes = spark.createDataFrame([(t, f"the and of w{t} W{t}") for t in range(30)], "take_id long, text string")
    lines = spark.createDataFrame([(x, f"of, the and w{x}!") for x in range(30)], "line_id long, text string")
    df = matching.bounded_pairs(takes, lines)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(take_id" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r.take_id, r.line_id): round(r.containment, 2) for r in df.collect()} == {(t, x): 1.0 if t == x else 0.75 for t in range(30) for x in range(30)}


def test_texts_are_compared_only_where_the_ratio_can_count(spark):
    takes = spark.createDataFrame([(1, "a b c d " + "x " * 500), (2, "a b c d")], "take_id long, text string")
    lines = spark.createDataFrame([(1, "a b c d")], "line_id long, text string")
    bound = {r.take_id: r.ratio_bound > 0.9 * r.containment for r in matching.reachable(takes, lines, 0.55).collect()}
    assert bound == {1: False, 2: True}
    assert {r.take_id: r.score for r in matching.match_scores(takes, lines).collect()} == {1: 0.9, 2: 1.0}


def test_rows_that_repeat_an_id_or_have_none_are_scored(spark):
    """Each row is a text of its own: one long take doesn't hide another of its id, equal rows don't add up."""
    line = "a b c d e f g h"
    takes = [(1, "x " * 1000), (1, "a b c d e y"), (None, line), (2, line), (2, line), (3, ""), (4, None)]
    lines = [(1, line), (None, "h g f e d c b a i"), (7, "a b c"), (7, "e f g h")]

    def score(x, y):
        a, b = (x or "").split(), y.split()
        return max(SequenceMatcher(None, a, b).ratio(), 0.9 * len(set(a) & set(b)) / len(set(b))) if a else 0.0

    every = [(t, n, round(score(x, y), 9)) for t, x in takes for n, y in lines]
    given = spark.createDataFrame(takes, "take_id long, text string"), spark.createDataFrame(lines, "line_id long, text string")
    for least in (0.55, 0.0):
        got = [(r.take_id, r.line_id, round(r.score, 9)) for r in matching.match_scores(*given, least).collect()]
        assert sorted((r for r in got if r[2] >= least), key=str) == sorted((r for r in every if r[2] >= least), key=str)


def least_moves(rows):
    """Shots as the rule says them, one removal at a time."""
    kept = []
    for t, c in sorted(rows):
        if not kept or abs(c - kept[-1][1]) >= matching.SAME_CENTER:
            kept.append((t, c))
    while len(kept) > matching.MOST_SHOTS:
        k = min(range(1, len(kept)), key=lambda k: (abs(kept[k][1] - kept[k - 1][1]), k))
        kept.pop(k)
    return kept


def test_shots_of_long_tracks(spark):
    """Tracks of 400 shots by the rule, one of 60,000 that a fold with copies would not end."""
    rng = random.Random(1)
    rows = [(k, t * 750, rng.randrange(23) / 22) for k in (1, 2, None) for t in range(400 if k else 30)]
    shots = spark.createDataFrame(rows, "track_id long, start_ms long, center double")
    got = {}
    for r in matching.folded_shots(shots).collect():
        got.setdefault(r.track_id, []).append((r.start_ms, r.center))
    assert {k: sorted(v) for k, v in got.items()} == {k: least_moves([(t, round(c, 4)) for i, t, c in rows if i == k]) for k in (1, 2, None)}
    many = spark.range(60_000).selectExpr("7L AS track_id", "id * 750 AS start_ms", "(id * 7 % 23) / 22.0D AS center")
    assert matching.folded_shots(many).count() == matching.MOST_SHOTS
