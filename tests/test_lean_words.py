"""Words of texts, their pieces and titles: few rows are sorted, lone pieces aren't grouped, a title is worked out once."""

import random
import re

from pyspark.sql import functions as F

from cadenza.operators import transcript
from cadenza.sources import bridge


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def fold(text):
    """(idx, line_no, word, start_ms, end_ms) by a loop over the words."""
    out, ends = [], 0
    for line_no, line in enumerate(text.split("\n")):
        for pos, word in enumerate(re.split("[ \t\r]+", line)):
            for w in ([bridge.SPICE[(line_no + pos) % len(bridge.SPICE)]] if word and pos % 17 == 0 else []) + ([word] if word else []):
                start = len(out) * 400 + ends * 300 + line_no * 1500
                out.append((len(out), line_no, w, start, start + 400))
                ends += w[-1] in ".!?"
    return out


def test_words_are_timed_by_parts_of_lines(spark, capsys, tmp_path):
    rnd = random.Random(6)
    line = lambda: "".join(rnd.choice(["a", "b.", "c!?", ".", " ", "  ", " ", "\t", "\r", " ", "d, ", " é? ", " 🔥."]) for _ in range(rnd.randint(0, 90)))
    texts = ["", " ", "\n\n", ". . .", " .", "a. ", "a.\r\nb", "? \n !", " ".join("x" * 40), " " + " ".join("x" * 40), *("\n".join(line() for _ in range(rnd.randint(1, 6))) for _ in range(60)), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = bridge.words(spark, str(tmp_path))
    got = sorted(map(tuple, words.collect()))
    assert got == [(k, *row) for k, text in enumerate(texts) if text is not None for row in fold(text)]
    out = plan(words, capsys)
    assert out.index("posexplode(words") < out.index("Window")  # windows see parts of lines, words are cut from them afterwards


def test_lone_pieces_are_not_grouped(spark, capsys):
    rows = [(1, i, w, i * 10, i * 10 + (50 if w == "-long" else 5)) for i, w in enumerate(["-first", "-x", "a", "-long", "-b", "c", "-", "d"] + ["-"] * 300)]
    rows += [(2, 0, "only", 3, 4), (3, 5, None, 1, 2), (3, 6, "-y", 2, 9)]
    merged = transcript.merge_pieces(spark.createDataFrame(rows[::-1], "project_id long, idx long, word string, start_ms long, end_ms long"))
    want = [(1, 0, "-first-x", 0, 15), (1, 2, "a-long-b", 20, 80), (1, 5, "c-", 50, 65), (1, 7, "d" + "-" * 300, 70, 3075), (2, 0, "only", 3, 4), (3, 5, "-y", 1, 9)]
    assert sorted(map(tuple, merged.collect())) == want
    assert "Aggregate" not in plan(merged, capsys)


def test_a_title_is_worked_out_once(spark, capsys):
    texts = {"": "Untitled moment", " ... (!) ": "Untitled moment", '"why," (the) END of: it. one more': "Why the END of It One", "a.b ..c.. -d' x": "A.b C -d X", "(the": "The", "\t[of] \n a ;": "Of a"}
    titles = spark.createDataFrame([(t,) for t in texts], "t string").select("t", transcript.title_of(F.col("t")).alias("title"))
    assert {r.t: r.title for r in titles.collect()} == texts
    assert plan(titles, capsys).split("== Physical Plan ==")[1].count("split(") == 1
