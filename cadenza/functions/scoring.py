"""Column functions for engagement and for texts that may be missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTERS = ["views", "follows", "saves", "sends"]
#: What one of each counter is worth.
WORTH = {"views": 0.001, "follows": 5, "saves": 3, "sends": 2}


def thousandths(views: str = "views", follows: str = "follows", saves: str = "saves", sends: str = "sends") -> Column:
    """Weighted engagement as a whole number of thousandths; a null counter is zero."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return n(saves) * 3000 + n(follows) * 5000 + n(sends) * 2000 + n(views)


def perf_score(views: str = "views", follows: str = "follows", saves: str = "saves", sends: str = "sends") -> Column:
    """Weighted engagement to three places; a null counter is zero."""
    return thousandths(views, follows, saves, sends) / F.lit(1000.0)


def blank_to_null(c: Column) -> Column:
    """Text that is empty is as good as missing."""
    return F.when(c != "", c)


def filled(c: str) -> Column:
    """Not null and not empty."""
    return F.coalesce(F.col(c), F.lit("")) != ""


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty; a text of blanks counts."""
    return F.coalesce(*map(blank_to_null, columns))


def said(c: Column, otherwise: Column) -> Column:
    """The text without blanks at its ends, or `otherwise` where nothing is left."""
    return F.coalesce(blank_to_null(stripped(c)), otherwise)


def safe_name(c: Column, fallback: Column) -> Column:
    """A file's name: what file systems refuse becomes a space."""
    return F.concat(said(F.regexp_replace(c, r'[\\\\/:*?"<>|]+', " "), fallback), F.lit(".mp4"))
