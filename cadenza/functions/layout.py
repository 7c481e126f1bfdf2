"""Widths of caption text in thousandths of an em, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths of a bold sans face in thousandths of an em, in the order of the characters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER_EM = [722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611]
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_EM = [556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500]
DIGITS, DIGIT_EM = "0123456789", 556
MARKS = " .,:;!?'\"-%$&()/"
MARKS_EM = [278, 278, 278, 333, 333, 333, 611, 238, 474, 333, 889, 556, 722, 333, 333, 278]
OTHER_EM, EMOJI_EM = 611, 1150
# The growth of the active word in hundredths, margins in pixels, and the limits of scaling.
ACTIVE_POP, EMPHASIS_POP, MARGIN, LEAST_SCALE, SPLIT_BELOW = 112, 118, 80, 0.45, 0.8

WIDTHS = dict(zip(UPPER, UPPER_EM, strict=True)) | dict(zip(LOWER, LOWER_EM, strict=True)) | dict.fromkeys(DIGITS, DIGIT_EM) | dict(zip(MARKS, MARKS_EM, strict=True))


BY_WIDTH = {w: "".join(c for c in WIDTHS if WIDTHS[c] == w) for w in sorted(set(WIDTHS.values()))}
#: Beyond U+2000 and neither a letter nor a number.
EMOJI = r"[^\x{0}-\x{2000}\p{L}\p{N}]"


def char_class(chars: str) -> str:
    """A pattern's class of these characters."""
    return "[" + "".join("\\" + c if c in "-\\]^[&" else c for c in chars) + "]"


#: Each character's stand-in: the first of its width.
STAND_IN = str.maketrans({c: chars[0] for chars in BY_WIDTH.values() for c in chars})


def text_em(text: Column) -> Column:
    """Width of a text: its characters are replaced by one for each width in a single step and these are counted, without a pattern or a lookup for each."""
    chars = "".join(WIDTHS)
    shown = F.translate(text, chars, chars.translate(STAND_IN))
    count = lambda c: F.length(shown) - F.length(F.replace(shown, F.lit(c), F.lit("")))
    total = F.length(text) * OTHER_EM
    for width, same in BY_WIDTH.items():
        if width != OTHER_EM:
            total = total + count(same[0]) * (width - OTHER_EM)
    emoji = F.length(text) - F.length(F.regexp_replace(text, EMOJI, ""))
    return total + F.when(F.octet_length(text) == F.length(text), 0).otherwise(emoji) * (EMOJI_EM - OTHER_EM)


def word_em(word: Column, emphasis: Column, emoji: Column) -> Column:
    """Width of a caption's word when it is spoken, with its emoji after a space; emphasised words grow more."""
    shown = F.concat_ws(" ", word, F.when(emoji != "", emoji))
    return text_em(shown) * F.when(emphasis, EMPHASIS_POP).otherwise(ACTIVE_POP) / 100.0


def scale_for(row_em: Column, size: int, outline: int, canvas: int) -> Column:
    """How far a row of thousandths of an em must shrink to lie inside the margins."""
    room, width = canvas - 2 * MARGIN, row_em * size / 1000.0
    return F.when(width + 2 * outline <= room, 1.0).otherwise(F.greatest(F.lit(LEAST_SCALE), (room - 2 * outline) / width))


def fit_layout(widths: Column, size: int = 126, outline: int = 10, canvas: int = 1080) -> Column:
    """struct(scale, split) of a caption line's words (array of thousandths, pops included); split is null for one row."""
    gap = WIDTHS[" "]
    row = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, w: s + w) + gap * F.greatest(n - 1, F.lit(0))
    n = F.size(widths)
    # sums and scales are needed several times: arrays of one carry them
    wider = lambda em: F.get(F.transform(F.array(em), lambda r: scale_for(r, size, outline, canvas)), F.lit(0))
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(wider(F.greatest(row(F.slice(widths, F.lit(1), k), k), row(F.slice(widths, k + 1, n), n - k))).alias("scale"), k.alias("split")))
    alone = lambda one: F.struct(one.alias("scale"), F.lit(None).cast("int").alias("split"))
    best = lambda one: F.aggregate(two, alone(one), lambda b, x: F.when(x["scale"] > b["scale"] + 1e-9, x).otherwise(b))
    return F.get(F.transform(F.array(wider(row(widths, n))), lambda one: F.when((one >= SPLIT_BELOW) | (n < 2), alone(one)).otherwise(best(one))), F.lit(0))


#: What Unicode takes for white space, as a pattern's class; the line feed is the only one that ends a paragraph.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def filling(most: int) -> str:
    """A pattern that takes a line's words from a text with single spaces: a word that is too long alone, else as many as fit."""
    return rf"([^ ]{{{most + 1},}}|[^\n]{{1,{most}}})(?: |\z)"


def wrapped(text: Column, most: int) -> Column:
    """Lines of a title, filled greedily up to `most` characters; its own line feeds stay, blank lines at its ends go.

    A line is one match of a pattern, so the time is proportional to the text, however long.
    """
    single = lambda para: F.trim(F.regexp_replace(para, BLANKS + "+", " "))
    fill = lambda para: F.split(F.regexp_replace(F.regexp_replace(single(para), filling(most), "$1\n"), r"\n\z", ""), "\n")
    lines = F.flatten(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), fill))
    said = F.filter(F.transform(lines, lambda x, k: F.when(x != "", k)), lambda k: k.isNotNull())
    return F.when(F.size(said) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.array_min(said) + 1, F.array_max(said) - F.array_min(said) + 1))


def fit_title(text: Column, place: str, width: int, height: int) -> Column:
    """struct(lines, size) of a title broken into lines that fit its column; a word that is too wide makes it smaller."""
    left, right = title_margins(place, width)
    column = max(1, width - left - right)
    size = max(40, int(height * (SIDE_SIZE if place in ("left", "right") else FULL_SIZE)))
    lines = wrapped(text, max(5, int(column / (CHAR_EM * size))))
    widest = F.array_max(F.transform(lines, F.length)) * (CHAR_EM * size)
    return F.struct(lines.alias("lines"), F.when(widest > column, F.greatest(F.lit(24), F.floor(size * column / widest))).otherwise(size).cast("int").alias("size"))


# Fixed values of titles: their places and styles.
PLACES, TITLE_STYLES = ["left", "right", "top", "bottom", "center"], ["bold", "glow", "boxed"]
# Fixed values of titles: width of a character, shares of the canvas for the size, the edge and the column beside a side title.
CHAR_EM, SIDE_SIZE, FULL_SIZE, EDGE, GUTTER = 0.60, 0.062, 0.072, 0.06, 0.36


def title_margins(place: str, width: int) -> tuple[int, int]:
    edge, gutter = int(width * EDGE), int(width * GUTTER)
    return {"left": (edge, gutter), "right": (gutter, edge)}.get(place, (edge, edge))


def normal_title(title: Column) -> Column:
    """A title struct(text, place, style, start, duration) with defaults and bounds; null where there is nothing to draw."""
    text = F.regexp_replace(F.coalesce(title["text"], F.lit("")), r"^\s+|\s+$", "")
    one_of = lambda c, values, default: F.when(title[c].isin(values), title[c]).otherwise(default)
    number = lambda c, default: F.coalesce(title[c].try_cast("double"), F.lit(default))
    start, duration = F.greatest(F.lit(0.0), number("start", 0.0)), F.least(F.lit(120.0), F.greatest(F.lit(0.4), number("duration", 3.0)))
    return F.when(text != "", F.struct(text.alias("text"), one_of("place", PLACES, "left").alias("place"), one_of("style", TITLE_STYLES, "bold").alias("style"), F.round(start, 3).alias("start"), F.round(duration, 3).alias("duration")))


def crop_window(width: Column, height: Column, ratio_w: int, ratio_h: int, center: Column) -> Column:
    """struct(w, h, x, y) of a crop to a ratio about a center; rounds half to even."""
    wide = width * ratio_h > height * ratio_w
    w = F.when(wide, F.least(width, F.bround(height * ratio_w / F.lit(float(ratio_h))))).otherwise(width).cast("long")
    h = F.when(wide, height).otherwise(F.least(height, F.bround(width * ratio_h / F.lit(float(ratio_w))))).cast("long")
    x = F.greatest(F.lit(0), F.least(width - w, F.bround(center * width - w / 2.0))).cast("long")
    return F.struct(w.alias("w"), h.alias("h"), x.alias("x"), F.floor((height - h) / 2).alias("y"))
