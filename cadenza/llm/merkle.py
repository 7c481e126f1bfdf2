"""Operator 12: a Merkle manifest of a dataset, with a proof for each document.

Leaves are placed by rank in bitmaps, not by sorting them. The ids of each group are merged into 64-bit words of a bitmap (only
words that hold an id exist), each word counts its rows, and a running sum over the words is the directory:
a leaf's place is its word's start plus the set bits below its own. The tree then rises by keyed slot arrays: nodes of one group whose places
agree but for the last two digits in base `fanout` meet in one array and give one node two levels up; the groups' subroots are
the leaves of a last such tree. Proofs come down the same arrays, so each leaf is read with its siblings of two levels at a time.

Rows that repeat an id, and rows without one, can't be told by a bit. Only the words that hold more rows than
bits take a second way: their rows are numbered by (id, leaf) in ranges of a sort. Equal rows take places of their own, next to each other.

Defined results: a null id comes first in its group and is never tampered with in the query; null fields and null groups have their own encoding; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.ordering import running
from cadenza.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_ID = -(1 << 60)  # no id has this word
EDGES = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def leaves(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """(grp, id, row, leaf, claimed): each document's leaf, and the leaf it has with `claimed_text` as its text.

    Groups order as null first, then by the bytes of the lang.
    """
    fields = [F.col(f) for f in FIELDS]
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    found = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), digest(fields).alias("leaf"), digest([*fields[:-1], claimed_text]).alias("claimed"))
    return stored(found, "leaves")


def placed(rows: DataFrame) -> DataFrame:
    """(grp, rank, n, ...) of all rows: the place in its group and the group's size."""
    word = F.coalesce(F.shiftright("id", 6), F.lit(NO_ID))
    slot = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    at = rows.withColumn("word", word).withColumn("slot", slot)
    own = F.expr("shiftleft(1L, slot)")
    words = at.groupBy("grp", "word").agg(F.coalesce(F.bit_or(own), F.lit(0)).alias("bits"), F.count("*").alias("rows"))
    directory = stored(running(words, ["grp", "word"], "rows"), "directory")
    groups = stored(directory.groupBy("grp").agg(F.min("before").alias("first"), F.sum("rows").alias("n")), "groups")
    directory = stored(directory.join(groups, "grp").select("grp", "word", "bits", "rows", "n", (F.col("before") - F.col("first")).alias("start")), "directory")
    crowded = F.col("rows") > F.bit_count("bits")
    plain = at.join(directory.where(~crowded), ["grp", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, slot))")
    kept = [*rows.columns, "n"]
    found = plain.select(*kept, (F.col("start") + below).alias("rank"))
    if directory.where(crowded).isEmpty():
        return found
    numbered = stored(running(at.join(directory.where(crowded), ["grp", "word"]).select(*kept, "word", "start"), ["grp", "word", "id", "leaf", "row"]), "numbered")
    firsts = stored(numbered.groupBy("grp", "word").agg(F.min("before").alias("first")), "firsts")
    return found.unionByName(numbered.join(firsts, ["grp", "word"]).select(*kept, (F.col("start") + F.col("before") - F.col("first")).alias("rank")))


class Tree:
    """A tree for each grp over nodes (grp, rank, n, digest, ...), whose further columns stay with the lowest slots."""

    def __init__(self, nodes: DataFrame, largest: int, fanout: int):
        self.fanout, self.passes = fanout, []
        while True:
            extra = [c for c in nodes.columns if c not in ("grp", "n")]
            slots = F.array_sort(F.collect_list(F.struct("rank", *[c for c in extra if c != "rank"])))
            met = nodes.groupBy("grp", F.expr(f"rank div {fanout**2}").alias("at")).agg(F.first("n").alias("n"), slots.alias("slots"))
            self.passes.append(stored(met, "slots"))
            mid = F.array_join(self.up(F.col("slots.digest"), F.col("n")), "")  # at most `fanout` nodes; one is its own parent at the end of a tree
            top = F.when(self.above(F.col("n")) > 1, F.sha2(mid, 256)).otherwise(mid)
            nodes = self.passes[-1].select("grp", F.col("at").alias("rank"), self.above(self.above(F.col("n"))).alias("n"), top.alias("digest"))
            largest = -(-largest // fanout**2)
            if largest <= 1:
                break
        self.roots = stored(nodes.select("grp", "digest"), "roots")

    def above(self, n: Column) -> Column:
        """The nodes of the next level."""
        return F.ceil(n / self.fanout).cast("long")

    def run(self, nodes: Column, number: Column) -> Column:
        return F.slice(nodes, number * self.fanout + 1, F.lit(self.fanout))

    def up(self, nodes: Column, n: Column) -> Column:
        """An array of nodes, one level up; a level of one node is the end."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / self.fanout).cast("int"))
        return F.when(n > 1, F.transform(numbers, lambda k: F.sha2(F.array_join(self.run(nodes, k), ""), 256))).otherwise(nodes)

    def beside(self, nodes: Column, place: Column, n: Column) -> Column:
        """The siblings left and right of a node, joined; null where the level has but one node."""
        run = self.run(nodes, F.floor(place / self.fanout).cast("int"))
        own = (place % self.fanout).cast("int")
        return F.when(n > 1, F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, F.lit(self.fanout)), "").alias("right")))

    def down(self, tops: DataFrame) -> DataFrame:
        """(grp, ..., path) of the lowest nodes; tops has a row a grp with the path above its root and columns to hand down."""
        handed = [c for c in tops.columns if c not in ("grp", "path")]
        paths = tops.withColumn("at", F.lit(0).cast("long"))
        for k, step in reversed(list(enumerate(self.passes))):
            at = step.join(paths, ["grp", "at"])
            at = at.withColumn("low", F.col("slots.digest")).withColumn("mid", self.up(F.col("low"), F.col("n")))
            each = at.select("grp", "n", "low", "mid", "path", *handed, F.posexplode("slots").alias("place", "slot"))
            own = F.array_compact(F.array(self.beside(F.col("low"), F.col("place"), F.col("n")), self.beside(F.col("mid"), F.floor(F.col("place") / self.fanout).cast("int"), self.above(F.col("n")))))
            given = each.select("grp", *handed, F.concat(own, "path").alias("path"), "slot.*")
            paths = given.select("grp", F.col("rank").alias("at"), "path", *handed) if k else given
        return paths


def proofs(docs: DataFrame, claimed_text: Column | None = None, fanout: int = 8) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `claimed_text` is the text that someone presents with the document's proof; folded_root is what it leads to.
    """
    found = leaves(docs, F.col("text") if claimed_text is None else claimed_text)
    ranked = stored(placed(found), "ranked")
    if ranked.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    largest, groups = ranked.agg(F.max("n"), F.count_if(F.col("rank") == 0)).first()
    tree = Tree(ranked.select("grp", "rank", "n", F.col("leaf").alias("digest"), "id", "claimed"), largest, fanout)
    subroots = running(tree.roots, ["grp"]).select(F.lit(0).alias("grp"), F.col("before").alias("rank"), F.lit(groups).cast("long").alias("n"), "digest", F.col("grp").alias("group"))
    whole = Tree(subroots, groups, fanout)
    root = whole.roots.first()["digest"]
    start = whole.roots.select("grp", F.array().cast(EDGES).alias("path"))
    tops = stored(whole.down(start).select(F.col("group").alias("grp"), F.col("digest").alias("subroot"), "path"), "tops")
    each = tree.down(tops)
    folded = F.aggregate("path", F.col("claimed"), lambda node, by: F.sha2(F.concat(by["left"], node, by["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda by: F.concat(by["left"], by["right"])), ""), 256)
    out = each.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_third(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A text with A-Z lower-cased where 3 divides the crc32 of the decimal id."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text))


#: The same rows in DuckDB. crc32 is a fold over bytes with a table made by its rule; levels rise in a recursive query.
ORACLE = r"""
WITH RECURSIVE
steps(i, k, c) AS (SELECT i, 0, i FROM range(256) AS bytes(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
given AS (SELECT *, coalesce('=' || lang, '-') AS grp, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)),
            lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed FROM documents, crc),
front AS (SELECT doc_id, grp, text, claimed,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM given),
leaves AS (SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claimed FROM front),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree(grp, level, place, digest, n) AS (
  SELECT grp, 0, place, leaf, count(*) OVER (PARTITION BY grp) FROM ranked
  UNION ALL SELECT grp, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY grp, level, place // 8),
subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper(level, place, digest, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, place // 8),
runs AS (SELECT grp, level, place // 8 AS run, list(digest ORDER BY place) AS nodes FROM tree WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, place // 8 AS run, list(digest ORDER BY place) AS nodes FROM upper WHERE n > 1 GROUP BY ALL),
powers AS (SELECT k, (8 ** k)::BIGINT AS width FROM range(21) AS p(k)),
low_path AS (SELECT r.grp, r.place, list(struct_pack(l := array_to_string(u.nodes[1:r.place // p.width % 8], ''), r := array_to_string(u.nodes[r.place // p.width % 8 + 2:], '')) ORDER BY u.level) AS path
             FROM ranked r JOIN runs u ON u.grp = r.grp JOIN powers p ON p.k = u.level AND u.run = r.place // (p.width * 8) GROUP BY r.grp, r.place),
top_path AS (SELECT s.grp, list(struct_pack(l := array_to_string(u.nodes[1:s.place // p.width % 8], ''), r := array_to_string(u.nodes[s.place // p.width % 8 + 2:], '')) ORDER BY u.level) AS path
             FROM subroots s JOIN powers p ON true JOIN upper_runs u ON p.k = u.level AND u.run = s.place // (p.width * 8) GROUP BY s.grp),
told AS (SELECT r.doc_id, r.leaf, r.claimed, s.subroot, (SELECT digest FROM upper WHERE n = 1) AS root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
         FROM ranked r JOIN subroots s ON s.grp = r.grp LEFT JOIN low_path a ON a.grp = r.grp AND a.place = r.place LEFT JOIN top_path b ON b.grp = r.grp),
folded AS (SELECT *, list_reduce(list_prepend(struct_pack(l := claimed, r := ''), path), lambda a, b: struct_pack(l := sha256(b.l || a.l || b.r), r := '')).l AS folded_root FROM told)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
