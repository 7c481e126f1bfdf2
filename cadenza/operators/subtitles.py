"""Subtitle text in the ASS format, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import layout
from cadenza.operators import intervals, transcript

# Caption styles by name, with size, colours, outline, shadow, capitals, words in a line and position.
STYLE = "font size color highlight outline_color outline shadow bold uppercase max_words position".split()
PRESETS = {
    "cinematic": ("Arial", 126, "#FFFFFF", "#FFD400", "#000000", 10, 0, 1, True, 2, "mid"),
    "capcut": ("Arial", 92, "#FFFFFF", "#FFD400", "#000000", 7, 0, 1, False, 4, "bottom"),
    "hormozi": ("Arial", 104, "#FFFFFF", "#22FF55", "#000000", 8, 0, 1, True, 3, "mid"),
    "beasty": ("Arial", 110, "#FFFFFF", "#00E5FF", "#000000", 6, 3, 1, True, 3, "mid"),
    "clean": ("Arial", 72, "#F2F2F2", "#FFFFFF", "#000000", 3, 0, 1, False, 6, "bottom"),
}
OTHERWISE = "capcut"
ALIGN = {"top": 8, "mid": 5, "bottom": 2}
# The lines of the format's head.
INFO = "[Script Info]\nScriptType: v4.00+\nPlayResX: {w}\nPlayResY: {h}\nWrapStyle: 2\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
EVENTS = "\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def style(preset: str, overrides: dict | None = None) -> dict:
    """A style by name, with the overrides that name one of its fields and aren't null."""
    base = dict(zip(STYLE, PRESETS.get(preset, PRESETS[OTHERWISE]), strict=True))
    return base | {k: v for k, v in (overrides or {}).items() if k in base and v is not None}


def time_of(seconds: Column) -> Column:
    """h:mm:ss.cc; hundredths that round up to a whole second go to the seconds only, which may become 60."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    cs = F.bround((s - whole) * 100).cast("int")
    carried = F.when(cs == 100, 1).otherwise(0)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60 + carried, F.when(cs == 100, 0).otherwise(cs))


def colour(web: Column, alpha: str | None = None) -> Column:
    """&HAABBGGRR from #RRGGBB or #RGB; without an alpha the inline form &HBBGGRR&."""
    bare = F.regexp_replace(web, "^#+", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    bgr = F.concat(F.substring(full, 5, 2), F.substring(full, 3, 2), F.substring(full, 1, 2))
    return F.upper(F.concat(F.lit("&H"), F.lit(alpha or ""), bgr, F.lit("" if alpha is not None else "&")))


def escaped(text: Column) -> Column:
    """User text without markup; line feeds become hard breaks."""
    for old, new in (("\\", "∖"), ("{", "("), ("}", ")"), ("\r", ""), ("\n", "\\N")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Fixed values of titles: where each place aligns, how far from the edge it lies, the size that outlines are told for, and each
# style's passes: its name, the outline's colour (the caption's highlight where it is None), the back's, border, outline and shadow.
TITLE_ALIGN = {"left": 4, "right": 6, "top": 8, "bottom": 2, "center": 5}
TITLE_EDGE = {"top": 0.10, "bottom": 0.26}
TITLE_SIZE, POP_SCALE = 138.0, 86
TITLE_PASSES = {
    "bold": [("Title", "&H00000000", "&H90000000", 1, 9, 5)],
    "glow": [("TitleGlow", None, "&H00000000", 1, 20, 0), ("Title", "&H00000000", "&HA0000000", 1, 4, 4)],
    "boxed": [("Title", "&H20000000", "&H20000000", 3, 14, 0)],
}


def by_place(title: Column, f) -> Column:
    """f(place) for the title's place; null without a title."""
    return F.coalesce(*[F.when(title["place"] == place, f(place)) for place in layout.PLACES])


def title_styles(title: Column, p: dict, width: int, height: int) -> Column:
    """The style lines that a title (as layout.normal_title gives it) adds to the head, each after a line feed; outlines keep to the type's size."""

    def lines(place: str) -> Column:
        left, right = layout.title_margins(place, width)
        size = layout.fit_title(title["text"], place, width, height)["size"]
        k = size / TITLE_SIZE
        tail = f",{TITLE_ALIGN[place]},{left},{right},{int(height * TITLE_EDGE.get(place, 0.0))},1"

        def line(name: str, outline_colour: str | None, back: str, border: int, outline: int, shadow: int) -> Column:
            tone = colour(F.lit(p["highlight"]), "40") if outline_colour is None else F.lit(outline_colour)
            widths = F.concat_ws(",", F.greatest(F.lit(1), F.bround(outline * k).cast("int")).cast("string"), F.bround(shadow * k).cast("int").cast("string"))
            return F.concat(F.lit(f"\nStyle: {name},{p['font']},"), size.cast("string"), F.lit(",&H00FFFFFF,&H00FFFFFF,"), tone, F.lit(f",{back},1,0,0,0,100,100,1,0,{border},"), widths, F.lit(tail))

        return F.coalesce(*[F.when(title["style"] == s, F.concat(*[line(*one) for one in passes])) for s, passes in TITLE_PASSES.items()])

    return by_place(title, lines)


def title_events(title: Column, width: int, height: int) -> Column:
    """The events of a title, each after a line feed: it fades in and out and grows a little at first; a glow is drawn before its text."""
    text = by_place(title, lambda place: escaped(F.array_join(layout.fit_title(title["text"], place, width, height)["lines"], "\n")))
    start = F.greatest(F.lit(0.0), title["start"])
    end = start + F.greatest(F.lit(0.4), title["duration"])
    fade = F.least(F.lit(400.0), F.greatest(F.lit(150.0), title["duration"] * 1000 / 6)).cast("int")

    def event(layer: int, name: str, extra: str = "") -> Column:
        head = F.concat(F.lit(f"\nDialogue: {layer},"), time_of(start), F.lit(","), time_of(end), F.lit(f",{name},,0,0,0,,"))
        return F.concat(head, F.format_string(f"{{\\fad(%1$d,%1$d){extra}\\fscx{POP_SCALE}\\fscy{POP_SCALE}\\t(0,%2$d,\\fscx100\\fscy100)}}", fade, fade + 60), text)

    return F.when(title["style"] == "glow", F.concat(event(1, "TitleGlow", "\\blur14"), event(2, "Title"))).otherwise(event(1, "Title"))


def header(p: dict, width: int, height: int, styles: Column | None = None) -> Column:
    tone = lambda c: colour(F.lit(p[c]), "00")
    margin = int(height * (0.10 if p["position"] == "bottom" else 0.0))
    base = F.concat_ws(",", F.lit(f"Style: Base,{p['font']},{p['size']}"), tone("color"), tone("color"), tone("outline_color"), F.lit(f"&H90000000,{p['bold']},0,0,0,100,100,0,0,1,{p['outline']},{p['shadow']},{ALIGN.get(p['position'], 2)},80,80,{margin},1"))
    return F.concat(F.lit(INFO.format(w=width, h=height)), base, F.lit("") if styles is None else styles, F.lit(EVENTS))


def subtitles(words: DataFrame, preset: str = "cinematic", overrides: dict | None = None, width: int = 1080, height: int = 1920, titles: DataFrame | None = None) -> DataFrame:
    """project_id, text: the whole subtitle file of each project's words (project_id, idx, word, start_ms, end_ms; emphasis and
    emoji may be given). Each word has an event that shows its line with the word highlighted; a line that is too wide
    is set smaller or on two rows. titles (project_id, title: struct of text, place, style, start and duration in seconds) add
    a title's styles and events; a project with a title and no words has a file too."""
    p = style(preset, overrides)
    base, high = colour(F.lit(p["color"])), colour(F.lit(p["highlight"]))
    given = {"emphasis": F.lit(False), "emoji": F.lit("")}
    w = words.withColumns({c: F.coalesce(F.col(c), d) if c in words.columns else d for c, d in given.items()}).where("trim(word) <> ''")
    shown = F.trim(F.upper("word") if p["uppercase"] else F.col("word"))
    w = transcript.lined(w.withColumn("shown", shown), p["max_words"])
    em = layout.word_em(F.col("shown"), F.col("emphasis"), F.col("emoji"))
    told = F.concat_ws(" ", "shown", F.when(F.col("emoji") != "", F.col("emoji")))
    span = lambda inner, start, end: F.concat(F.lit("{\\1c"), high, F.lit(start), inner, F.lit("{\\1c"), base, F.lit(end))
    active = span(told, "\\fscx112\\fscy112}", "\\fscx100\\fscy100}")
    plain = F.when(F.col("emphasis"), span(told, "\\b1\\fscx118\\fscy118}", "\\b0\\fscx100\\fscy100}")).otherwise(told)
    word = F.struct("idx", em.alias("em"), active.alias("active"), plain.alias("plain"), "start_ms", "end_ms")
    lines = w.groupBy("project_id", "seg", "part").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    lines = lines.withColumn("fit", layout.fit_layout(F.transform("ws", lambda x: x["em"]), p["size"], p["outline"], width))
    sized = F.when(F.col("fit.scale") < 1.0, F.concat(F.lit("{\\fs"), F.floor(F.lit(p["size"]) * F.col("fit.scale")).cast("string"), F.lit("}"))).otherwise("")

    def event(x: Column, i: Column) -> Column:
        parts = F.transform("ws", lambda y, j: F.when(i == j, y["active"]).otherwise(y["plain"]))
        split = F.col("fit.split")
        rows = F.concat(F.array_join(F.slice(parts, F.lit(1), split), " "), F.lit("\\N"), F.array_join(F.slice(parts, split + 1, F.size(parts)), " "))
        start = F.greatest(F.lit(0.0), x["start_ms"] / 1000.0)
        end = F.greatest(start + 0.05, x["end_ms"] / 1000.0)
        return F.struct(x["idx"].alias("idx"), F.concat(F.lit("Dialogue: 0,"), time_of(start), F.lit(","), time_of(end), F.lit(",Base,,0,0,0,,"), sized, F.when(split.isNull(), F.array_join(parts, " ")).otherwise(rows)).alias("line"))

    events = lines.select("project_id", F.inline(F.transform("ws", event)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    bodies = events.groupBy("project_id").agg(body.alias("body"))
    if titles is None:
        return bodies.select("project_id", F.concat(header(p, width, height), "body", F.lit("\n")).alias("text"))
    told = titles.select("project_id", layout.normal_title(F.col("title")).alias("title")).where("title is not null")
    j = bodies.join(told, "project_id", "full")
    styles = F.coalesce(title_styles(F.col("title"), p, width, height), F.lit(""))
    shown = F.regexp_replace(F.concat(F.coalesce("body", F.lit("")), F.coalesce(title_events(F.col("title"), width, height), F.lit(""))), "^\n", "")
    return j.select("project_id", F.concat(header(p, width, height, styles), shown, F.lit("\n")).alias("text"))


def clip_subtitles(words: DataFrame, clips: DataFrame, **style_of) -> DataFrame:
    """project_id, clip, text: a file for each clip (project_id, a, b in ms; perhaps title), its times from the clip's start.

    Words that overlap a clip belong to it; one that begins before it begins with it.
    """
    key = F.struct("project_id", F.col("a").alias("clip"))
    inside = intervals.words_in(words, clips.select("project_id", "a", "b"))
    given = [c for c in ("emphasis", "emoji") if c in words.columns]
    own = inside.select(key.alias("project_id"), "idx", "word", *given, (F.col("start_ms") - F.col("a")).alias("start_ms"), (F.col("end_ms") - F.col("a")).alias("end_ms"))
    titles = clips.select(key.alias("project_id"), "title") if "title" in clips.columns else None
    return subtitles(own, titles=titles, **style_of).select("project_id.*", "text")
