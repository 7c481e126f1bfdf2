"""JSON inside free text, as language models reply: fences, envelopes and single objects are tolerated, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = "struct<start:double,end:double,title:string,score:double,hook_sentence:string,reason:string>"
ENTRY = "struct<caption:string,hashtags:string,title:string,description:string,tags:string>"


def valid(text: Column, opens: str) -> Column:
    """The text if it is JSON that begins with `opens`."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare.startswith(opens) & F.get_json_object(bare, "$").isNotNull(), bare)


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "```[a-zA-Z]*", ""), r"^\s+|\s+$", "")


def json_object(text: Column) -> Column:
    """The object of a reply: the whole text without fences, or what lies from its first to its last brace; null without one."""
    t = unfenced(text)
    return F.coalesce(valid(t, "{"), valid(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), "{"))


def clips(text: Column) -> Column:
    """The clips of a reply: a bare array, the first list of an envelope, a single clip, or an array inside other text."""
    whole = valid(text, "{")
    lists = F.filter(F.map_values(F.from_json(whole, "map<string,string>")), lambda v: v.startswith("["))
    single = F.when(F.get_json_object(whole, "$.start").isNotNull() & F.get_json_object(whole, "$.end").isNotNull(), F.concat(F.lit("["), whole, F.lit("]")))
    inside = valid(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "[")
    found = F.coalesce(valid(text, "["), F.get(lists, F.lit(0)), single, inside)
    return F.coalesce(F.from_json(found, f"array<{CLIP}>"), F.array().cast(f"array<{CLIP}>"))


def strings(text: Column) -> Column:
    """A reply's list of texts: a JSON array, else its lines without bullets, numbers and quotes, eight at most."""
    t = unfenced(text)
    arrays = F.coalesce(valid(t, "["), valid(F.nullif(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.lit("")), "["))
    trimmed = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    listed = trimmed(F.from_json(arrays, "array<string>"))
    lines = F.transform(F.split(t, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(x, r'^[-*\d.)\s"\[\]]+', ""), r'^[",\[\] ]+|[",\[\] \s]+$', ""))
    return F.when(F.size(listed) > 0, listed).otherwise(F.slice(F.filter(lines, lambda x: x != ""), 1, 8))


def post_meta(text: Column) -> Column:
    """map of platform to copy from a reply; a list of tags or hashtags becomes a text, what is missing an empty one."""
    obj = json_object(text)

    def part(p: str, key: str) -> Column:
        v = F.get_json_object(obj, f"$.{p}.{key}")
        return F.coalesce(F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), " ")), v, F.lit(""))

    no = F.lit("")
    entry = lambda p, *keys: F.struct(*[(part(p, k) if k in keys else no).alias(k) for k in ("caption", "hashtags", "title", "description", "tags")])
    made = F.create_map(F.lit("tt"), entry("tt", "caption", "hashtags"), F.lit("ig"), entry("ig", "caption", "hashtags"), F.lit("yt"), entry("yt", "title", "description", "tags"))
    return F.when(obj.isNotNull(), made)


def suggestions(replies: DataFrame, sounds: list[str]) -> DataFrame:
    """id with emphasis, emoji, zoom (indices) and sfx, of replies (id, text, n words): indices in range, 14, 5 and 4 at most, known sounds."""
    obj = json_object(F.col("text"))
    fine = lambda i: (i >= 0) & (i < F.col("n"))
    ints = lambda key: F.filter(F.from_json(F.get_json_object(obj, f"$.{key}"), "array<int>"), lambda i: i.isNotNull() & fine(i))
    faces = F.map_filter(F.from_json(F.get_json_object(obj, "$.emoji"), "map<string,string>"), lambda k, v: k.rlike("^[0-9]+$") & fine(k.try_cast("int")) & (F.trim(v) != ""))
    heard = F.filter(F.from_json(F.get_json_object(obj, "$.sfx"), "array<struct<index:int,name:string>>"), lambda o: o.isNotNull() & fine(o["index"]) & o["name"].isin(sounds))
    return replies.select("id", F.slice(ints("emphasis"), 1, 14).alias("emphasis"), faces.alias("emoji"), F.slice(ints("zoom"), 1, 5).alias("zoom"), F.slice(heard, 1, 4).alias("sfx"))
