"""Algebra of ranges [a, b) in milliseconds, per key column.

Lookups by time (the range that holds a point, the step before it, the edge nearest to it) are running windows over one
sorted union of both sides, so no key's rows are multiplied with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, key: str = "project_id", touch: int = 1) -> DataFrame:
    """Ranges joined where they overlap or lie at most `touch` apart; empty ones go."""
    w = Window.partitionBy(key).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("a") > before + touch).cast("int"), F.lit(1))
    marked = ranges.where("b > a").withColumn("begins", begins)
    island = F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def total_ms(ranges: DataFrame, key: str = "project_id") -> DataFrame:
    """Of each key the time that its ranges take, overlaps counted once."""
    return merged(ranges, key).groupBy(key).agg(F.sum(F.col("b") - F.col("a")).alias("total_ms"))


def kept(cuts: DataFrame, spans: DataFrame, key: str = "project_id") -> DataFrame:
    """What is left of each key's span [lo, hi) after its cuts, with `base`: where it begins on the edited timeline."""
    no = [F.lit(None).cast("long").alias(c) for c in ("lo", "hi")]
    ends = spans.select(key, F.col("hi").alias("a"), F.col("hi").alias("b"), "lo", "hi")
    whole = Window.partitionBy(key)
    bounds = {"lo": F.max("lo").over(whole), "hi": F.max("hi").over(whole)}
    return gaps(cuts.select(key, "a", "b", *no).unionByName(ends).withColumns(bounds).where("lo is not null"), key)


def gaps(cuts: DataFrame, key: str = "project_id") -> DataFrame:
    """kept, of cuts (key, a, b, lo, hi) that carry their key's span and have among them one empty cut [hi, hi) at its end.

    A gap lies before each cut that begins after all earlier ones have ended: a running maximum, without a join.
    """
    inside = cuts.select(key, F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b"), "lo", "hi").where("b > a or a = hi")
    upto = Window.unboundedPreceding, -1
    before = F.max("b").over(Window.partitionBy(key).orderBy("a", "b").rowsBetween(*upto))
    out = inside.select(key, F.greatest("lo", F.coalesce(before, "lo")).alias("from"), F.col("a").alias("to")).where("to > from").select(key, F.col("from").alias("a"), F.col("to").alias("b"))
    base = F.coalesce(F.sum(F.col("b") - F.col("a")).over(Window.partitionBy(key).orderBy("a").rowsBetween(*upto)), F.lit(0))
    return out.withColumn("base", base)


def subtract(ranges: DataFrame, cuts: DataFrame, key: str = "project_id") -> DataFrame:
    """Each range without the cuts. Ranges and cuts meet in buckets of time, so a long key's aren't multiplied with each other.

    Both sides are read once: a range keeps a row without a cut for each bucket that has none, and only one of these counts, where no cut is met at all.
    """
    size = 60_000
    buckets = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(z) - 1) / size))).alias("bucket")
    own = ranges.where("b > a").select(key, "a", "b").distinct().select(key, "a", "b", buckets("a", "b"))
    met = merged(cuts, key).select(F.col(key).alias("other"), F.col("a").alias("ca"), F.col("b").alias("cb"), buckets("a", "b")).withColumnRenamed("bucket", "at")
    # a pair that shares several buckets is taken from the first
    first = F.greatest(F.floor(F.col("a") / size), F.floor(F.col("ca") / size))
    on = (F.col(key) == F.col("other")) & (F.col("bucket") == F.col("at")) & (F.col("ca") < F.col("b")) & (F.col("cb") > F.col("a")) & (F.col("bucket") == first)
    w = Window.partitionBy(key, "a", "b").orderBy(F.asc_nulls_last("ca"))
    j = own.join(met, on, "left").withColumn("nth", F.row_number().over(w)).where("ca is not null or nth = 1")
    left = j.withColumns({"x": F.coalesce(F.lag("cb").over(w), F.col("a")), "y": F.coalesce("ca", "b"), "last": F.lead("ca").over(w).isNull()})
    parts = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.when(F.col("last"), F.col("cb")).alias("a"), F.col("b").alias("b")))
    return left.select(key, F.inline(parts)).where("b > a")


def uncovered(ranges: DataFrame, covers: DataFrame, key: str = "project_id", slack: int = 1) -> DataFrame:
    """Ranges that no single cover holds within the slack.

    Of the covers that begin in time the one that ends last is the one to ask: a running maximum over one sorted union.
    """
    cols = [c for c in ranges.columns if c != key]
    mine = ranges.select(key, (F.col("a") + slack).alias("at"), F.lit(1).alias("is_range"), F.lit(None).cast("long").alias("until"), F.struct(*cols).alias("row"))
    theirs = covers.select(key, F.col("a").alias("at"), F.lit(0).alias("is_range"), F.col("b").cast("long").alias("until"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"))
    w = Window.partitionBy(key).orderBy("at", "is_range").rowsBetween(Window.unboundedPreceding, 0)
    met = mine.unionByName(theirs).withColumn("last", F.max("until").over(w)).where("is_range = 1")
    return met.where(F.col("last").isNull() | (F.col("last") < F.col("row.b") - slack)).select(*[c if c == key else f"row.{c}" for c in ranges.columns])


def monotone(timings: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """timings (key, order, start, end and duration in seconds) with times that never fall and lie within the duration.

    A start is no earlier than any before it, which is a running maximum; an end is at least 20 ms after its start.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.least(F.greatest(F.lit(0.0), F.max(F.coalesce("start", F.lit(0.0))).over(w)), F.col(duration))
    at = timings.withColumn("start", start)
    end = F.least(F.greatest(F.coalesce("end", F.lit(0.0)), F.col("start") + 0.02), F.col(duration))
    return at.withColumns({"start": F.bround("start", 3), "end": F.bround(end, 3)})


def inside_cuts(words: DataFrame, cuts: DataFrame, key: str = "project_id") -> DataFrame:
    """Words with `cut`: whether they overlap a cut."""
    ends = words.select(key, "idx", "start_ms", "end_ms", F.col("end_ms").alias("at"), F.lit(0).alias("is_range"), F.lit(None).cast("long").alias("b"))
    starts = merged(cuts, key).select(key, F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.col("a").alias("at"), F.lit(1).alias("is_range"), "b")
    # merged cuts end in the order they begin, so the last that begins before a word's end is the one to ask
    w = Window.partitionBy(key).orderBy("at", "is_range").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(starts).withColumn("until", F.last("b", ignorenulls=True).over(w))
    return both.where("is_range = 0").select(key, "idx", F.coalesce(F.col("until") > F.col("start_ms"), F.lit(False)).alias("cut"))


def remapped(words: DataFrame, segments: DataFrame, key: str = "project_id") -> DataFrame:
    """Words on the edited timeline, from their first kept overlap to their last; words without one go.

    Segments don't overlap. The first that a word reaches is the first to end after the word's start, the last one
    the last to begin before its end; both come from a window over words and segments.
    """
    no = F.lit(None).cast("struct<a:bigint,b:bigint,base:bigint>").alias("seg")
    seg = F.struct(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "base")]).alias("seg")
    w = words.select(key, "idx", F.col("start_ms").alias("from"), F.col("end_ms").alias("to"), F.lit(0).alias("is_seg"), no)
    s = segments.select(key, F.lit(None).cast("long").alias("idx"), F.col("b").alias("from"), F.col("a").alias("to"), F.lit(1).alias("is_seg"), seg)
    upto = Window.unboundedPreceding, 0
    after = Window.partitionBy(key).orderBy(F.desc("from"), "is_seg").rowsBetween(*upto)  # at equal times a word comes first and doesn't see the segment
    before = Window.partitionBy(key).orderBy("to", "is_seg").rowsBetween(*upto)
    both = w.unionByName(s).withColumns({"x": F.last("seg", ignorenulls=True).over(after), "y": F.last("seg", ignorenulls=True).over(before)})
    at = lambda g, t: F.col(f"{g}.base") + F.least(F.greatest(F.col(t), F.col(f"{g}.a")), F.col(f"{g}.b")) - F.col(f"{g}.a")
    met = both.where("is_seg = 0 and x.a < to and y.b > from").select(key, "idx", at("x", "from").alias("new_start"), at("y", "to").alias("e"))
    return met.select(key, "idx", "new_start", F.when(F.col("e") > F.col("new_start"), F.col("e")).otherwise(F.col("new_start") + 150).alias("new_end"))


def remapped_points(points: DataFrame, segments: DataFrame, key: str = "project_id", slack: int = 1) -> DataFrame:
    """Points of time on the edited timeline; those in no kept segment go. A point between two takes the earlier one."""
    no = F.lit(None).cast("struct<a:bigint,b:bigint,base:bigint>").alias("seg")
    p = points.select(key, "t", F.lit(0).alias("is_seg"), no).distinct()
    s = segments.select(key, (F.col("b") + slack).alias("t"), F.lit(1).alias("is_seg"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "base")]).alias("seg"))
    # the first segment to end after the point, slack included
    w = Window.partitionBy(key).orderBy(F.desc("t"), "is_seg").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s).withColumn("x", F.last("seg", ignorenulls=True).over(w))
    return both.where((F.col("is_seg") == 0) & (F.col("t") >= F.col("x.a") - slack)).select(key, "t", (F.col("x.base") + F.greatest(F.col("t") - F.col("x.a"), F.lit(0))).alias("new_t"))


def as_of(points: DataFrame, steps: DataFrame, key: str, default: float = 0.5) -> DataFrame:
    """The value of the last step at or before each point, else of the first step, else the default; one sort, no range join."""
    p = points.select(key, F.col("t"), F.lit(1).alias("is_point"), F.lit(None).cast("double").alias("value"))
    s = steps.select(key, F.col("start").alias("t"), F.lit(0).alias("is_point"), "value")
    w = Window.partitionBy(key).orderBy("t", "is_point")
    first = F.first("value", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", "is_point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    got = p.unionByName(s).withColumn("center", F.coalesce(F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first, F.lit(default)))
    return got.where("is_point = 1").select(key, "t", "center")


def last_begun(points: DataFrame, ranges: DataFrame, key: str = "project_id") -> DataFrame:
    """points (key, t) with `hit`: the columns of the range that begins last at or before t, at equal starts the one with the largest idx."""
    cols = [c for c in ranges.columns if c != key]
    hit = F.struct(*cols).alias("hit")
    r = ranges.select(key, F.col("start_ms").alias("t"), F.lit(0).alias("is_point"), F.col("idx").alias("o"), hit)
    p = points.select(key, "t", F.lit(1).alias("is_point"), F.lit(None).cast(ranges.schema["idx"].dataType).alias("o"), F.lit(None).cast(r.schema["hit"].dataType).alias("hit"))
    w = Window.partitionBy(key).orderBy("t", "is_point", "o").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(p).withColumn("hit", F.last("hit", ignorenulls=True).over(w)).where("is_point = 1").select(key, "t", "hit")


def begun_at_ticks(ranges: DataFrame, every: int, key: str = "project_id") -> DataFrame:
    """ranges with `t`: each multiple of `every` from 0 to the key's last end at which a range is the last to have begun, at equal starts the one with the largest idx.

    last_begun for regular points: they follow from a range's start and the next one's, without a second table.
    """
    w = Window.partitionBy(key).orderBy("start_ms", "idx")
    last = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = ranges.withColumn("upto", F.coalesce(F.lead("start_ms").over(w) - 1, last))
    first, step = F.greatest(F.ceil(F.col("start_ms") / every), F.lit(0)) * every, F.lit(every).cast("long")
    return x.withColumn("upto", F.least("upto", last)).select(*ranges.columns, F.explode(F.when(first <= F.col("upto"), F.sequence(first, "upto", step))).alias("t"))


def nearest(t: Column, before: Column, after: Column) -> Column:
    """Of the edges at or before t and at or after it the nearer one, the earlier of equals; null without any."""
    return F.when(after.isNull() | (t - before <= after - t), before).otherwise(after)


def around(edge: str, at: str, key: str, is_point: str = "is_point") -> tuple[Column, Column]:
    """The last non-null `edge` at or before each row's `at` and the first at or after it, over rows of edges and of points."""
    upto = Window.unboundedPreceding, 0
    asc = Window.partitionBy(key).orderBy(F.asc(at), is_point).rowsBetween(*upto)
    desc = Window.partitionBy(key).orderBy(F.desc(at), is_point).rowsBetween(*upto)
    return F.last(edge, ignorenulls=True).over(asc), F.last(edge, ignorenulls=True).over(desc)


def snapped(points: DataFrame, edges: DataFrame, key: str, within: int = 3000) -> DataFrame:
    """Each point moved to the nearest edge less than `within` away, the earliest among equals; else it stays."""
    e = edges.select(key, F.col("edge").alias("t"), F.lit(0).alias("is_point"), "edge")
    p = points.select(key, "t", F.lit(1).alias("is_point"), F.lit(None).cast(edges.schema["edge"].dataType).alias("edge")).distinct()
    before, after = around("edge", "t", key)
    near = e.unionByName(p).withColumns({"x": before, "y": after}).where("is_point = 1").withColumn("n", nearest(F.col("t"), F.col("x"), F.col("y")))
    return near.select(key, "t", F.when(F.abs(F.col("n") - F.col("t")) < within, F.col("n")).otherwise(F.col("t")).alias("snapped"))


def words_in(words: DataFrame, ranges: DataFrame, key: str = "project_id", bucket: int = 60_000) -> DataFrame:
    """Words and the ranges (clip, a, b) that they overlap, joined by the key and a bucket of time, so a long key's rows are spread."""
    w = words.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket), F.floor((F.col("end_ms") - 1) / bucket))))
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor((F.col("b") - 1) / bucket))))
    # a pair that shares several buckets is taken from the first
    first = F.greatest(F.floor(F.col("start_ms") / bucket), F.floor(F.col("a") / bucket))
    return w.join(r, [key, "bucket"]).where((F.col("end_ms") > F.col("a")) & (F.col("start_ms") < F.col("b")) & (F.col("bucket") == first)).drop("bucket")
