"""Operator 7: line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its lower-cased, space-separated words as a set. A line goes if an earlier line, by (doc_id, line
number), has a Jaccard similarity of at least the threshold, whether or not that line itself stays. Lines
without tokens stay. Texts keep their other lines, joined by line feeds.

1. Tokens of all documents are counted in a fixed number of hashed counters (a sketch whose size is a parameter,
   so it may go to every task). A token's rarity is its counter; the order is by rarity, then hash.
2. Equal sets become one, represented by their first line; later ones are decided there.
3. Each set has rows for its prefix: size - ceil(t * size) + 1 of its rarest tokens. Sets that reach the threshold share
   a prefix token. Rows that have a partner under a token's key within the length filter, the positional filter and
   the parity bound below are kept by one semi-join of a table with itself, which writes no pairs and reads one shuffle twice.
   The parity of a set has one bit for each of 128 classes of tokens, set where the set has an odd number of them, so two
   sets differ in at least as many tokens as their parities do in bits.
4. Only the sets among these few are looked up in the texts again. Each is first compared with one partner, the
   likeliest of the first sets of each size under its keys, so a group of near copies is decided by as many pairs as it
   has sets. Sets still open are compared with all earlier partners. Every comparison is of the words themselves.

Hashes choose candidates and tell equal sets (64 bits of a hash, 128 of parity, and the size); similarity is always verified
on words. Small sides are broadcast only after their rows have been counted, and joined by shuffle beyond `broadcast_rows`.

Null text: empty, one line without tokens. A null doc_id's lines all stay and remove none. Rows that repeat an id count as one
document: lines at the same place aren't compared, but where their texts differ, each line is decided by its own words. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import checkpointed, id_and_text, stored

COUNTERS = 1 << 20
PLACE = ["doc_id", "text_key", "line_no"]
SET = ["sid", "size", "even", "odd"]


def words_of(line: Column) -> Column:
    return F.split(F.lower(line), " ")


def rarity(docs: DataFrame) -> DataFrame:
    """One row with an array of COUNTERS numbers: twice the binary logarithm of the tokens counted in each."""
    token = F.explode(words_of(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("token")
    counted = docs.select(token).where("token <> ''").groupBy(F.xxhash64("token").bitwiseAND(COUNTERS - 1).alias("k")).count()
    every = docs.sparkSession.range(COUNTERS).select(F.col("id").alias("k")).join(counted, "k", "left")
    ranked = every.select("k", F.floor(2 * F.log2(F.coalesce("count", F.lit(0)) + 1)).cast("tinyint").alias("c"))
    in_order = F.sort_array(F.collect_list(F.struct("k", "c")))  # of COUNTERS entries, whatever the documents
    return checkpointed(ranked.agg(F.transform(in_order, lambda x: x["c"]).alias("classes")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line) of texts with ids."""
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")  # before the lines, so once for each text
    return keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sets_of(docs: DataFrame, threshold: float) -> DataFrame:
    """A row for each line with its place, its set's hash, size and parity (of negative hashes and of others), and its prefix's keys.

    What stands inside a call with a lambda is interpreted, so arrays that the next lambda reads are columns of their own;
    a column that is used twice stays one.
    """
    classes = F.col("classes")
    none = F.xxhash64(F.lit(""))  # of no word
    hashed = F.array_remove(F.array_distinct(F.transform(words_of("line"), lambda t: F.xxhash64(t))), none)
    rare = lambda h: F.coalesce(classes[h.bitwiseAND(COUNTERS - 1)], F.lit(0).cast("tinyint"))  # noqa: E731  never null: such arrays are sorted as plain numbers
    ranked = lambda h: F.shiftleft(rare(h).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    counters = rarity(docs).scalar().alias("classes")  # a scalar subquery: evaluated once, and no part of the rows
    words = lines_of(docs).select(*PLACE, hashed.alias("hashed"))
    marked = words.select(*PLACE, "hashed", F.sort_array(F.concat("hashed", F.array(F.lit(0).cast("long")))).alias("marked"))
    zero = F.array_position("marked", 0).cast("int")
    halves = marked.select(*PLACE, "hashed", F.slice("marked", 1, zero - 1).alias("low"), F.slice("marked", zero + 1, F.size("marked")).alias("high"))
    sized = halves.select("*", (F.size("low") + F.size("high")).alias("size"), counters)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    parity = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    keyed = sized.select(*PLACE, "size", F.sort_array(F.transform("hashed", ranked)).alias("keys"), parity("low").alias("even"), parity("high").alias("odd"))
    n = F.col("size")
    prefix = F.slice("keys", 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    found = keyed.select(*PLACE, F.xxhash64("keys").alias("sid"), "size", "even", "odd", prefix.alias("prefix"))
    short = F.transform("prefix", lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int"))
    return found.select(*PLACE, *SET, F.when(F.size("prefix") > 0, short).otherwise(F.array().cast("array<int>")).alias("prefix"))


def differing(x: str, y: str) -> Column:
    """At least so many tokens are in one of the two sets only."""
    apart = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return apart("even") + apart("odd")


def partners(x: str, y: str, threshold: float) -> Column:
    """Length filter, positional filter and the parities' bound, symmetric in x and y."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    need = F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    room = F.lit(1) + F.least(a - F.col(f"{x}.pos") - 1, b - F.col(f"{y}.pos") - 1)
    return (F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9) & (room >= need) & (differing(x, y) <= a + b - 2 * need)


def earlier(x: str, y: str) -> Column:
    """y's place comes before x's."""
    return (F.col(f"{y}.doc_id") < F.col(f"{x}.doc_id")) | ((F.col(f"{y}.doc_id") == F.col(f"{x}.doc_id")) & (F.col(f"{y}.line_no") < F.col(f"{x}.line_no")))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, all of fixed width; df is a stored table, so counting is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


def similar_sets(sets: DataFrame, docs: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """SET and PLACE of the sets that are similar to an earlier one; `sets` has a row for each set with its first place."""
    light = sets.select(*SET, F.posexplode("prefix").alias("pos", "key"))
    other = (F.col("x.sid") != F.col("y.sid")) | (F.col("x.even") != F.col("y.even")) | (F.col("x.odd") != F.col("y.odd"))
    found = light.alias("x").join(light.alias("y"), (F.col("x.key") == F.col("y.key")) & other & partners("x", "y", threshold), "left_semi")
    found = stored(found, "met")

    among = small(checkpointed(found.select(SET).distinct()), broadcast_rows)
    placed = checkpointed(sets.select(*SET, *PLACE).join(among, SET, "left_semi"))
    wanted = small(placed, broadcast_rows)
    met = found.join(wanted, SET)
    whose = small(checkpointed(placed.select("doc_id").distinct()), broadcast_rows)
    words = F.array_distinct(F.array_remove(words_of("line"), "")).alias("words")
    looked_up = lines_of(docs.join(whose, "doc_id", "left_semi")).join(wanted, PLACE).select(*SET, words)
    values = stored(looked_up.dropDuplicates(SET), "words")

    def sides(name: str) -> DataFrame:
        return values.select(*[F.col(c).alias(f"{name}_{c}") for c in SET], F.col("words").alias(name))

    def similar(pairs: DataFrame) -> DataFrame:
        """SET of the pairs' x whose words reach the threshold with y's."""
        both = pairs.join(sides("x"), [f"x_{c}" for c in SET]).join(sides("y"), [f"y_{c}" for c in SET])
        shared = F.size(F.array_intersect("x", "y"))
        alike = shared >= (F.size("x") + F.size("y") - shared) * threshold - 1e-9
        return both.where(alike).select([F.col(f"x_{c}").alias(c) for c in SET]).distinct()

    of = lambda side: [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in SET]
    candidate = (F.col("x.key") == F.col("y.key")) & earlier("x", "y") & partners("x", "y", threshold)
    heads = met.groupBy("key", "size").agg(F.min(F.struct("doc_id", "line_no", "sid", "even", "odd", "pos")).alias("h")).select("key", "size", "h.*")
    likely = met.alias("x").join(heads.alias("y"), candidate)
    best = F.min(F.struct(differing("x", "y").alias("d"), *of("y"))).alias("y")
    one = likely.groupBy(of("x")).agg(best).select([f"x_{c}" for c in SET] + [f"y.y_{c}" for c in SET])
    first = checkpointed(similar(one))
    still = met.join(first, SET, "left_anti")
    rest = similar(still.alias("x").join(met.alias("y"), candidate).select(*of("x"), *of("y")).distinct())
    return placed.join(first.unionByName(rest), SET, "left_semi")


def removed_lines(docs: DataFrame, threshold: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_key, line_no) of the lines that go; docs has doc_id and text."""
    lines = stored(sets_of(docs, threshold), "lines").where("size > 0")
    at = F.min(F.struct("doc_id", "line_no", "text_key")).alias("at")
    sets = stored(lines.groupBy(SET).agg(at, F.count("*").alias("n"), F.first("prefix").alias("prefix")).select(*SET, "at.*", "n", "prefix"), "sets")
    gone = checkpointed(similar_sets(sets, docs, threshold, broadcast_rows))

    # a set's other lines go as equal to its first; those at the first one's own place, of another text of its id, go if that one does
    named = [F.col(c).alias(f"at_{c}") for c in PLACE]
    repeated = sets.where("n > 1").select(*SET, *named).join(gone.select(*SET, F.lit(True).alias("similar")), SET, "left")
    copies = lines.select(*SET, *PLACE).join(small(checkpointed(repeated), broadcast_rows), SET)
    same_place = (F.col("doc_id") == F.col("at_doc_id")) & (F.col("line_no") == F.col("at_line_no"))
    first = same_place & (F.col("text_key") == F.col("at_text_key"))
    return gone.select(PLACE).unionByName(copies.where(~first & (~same_place | F.col("similar").isNotNull())).select(PLACE))


def deduplicated(docs: DataFrame, threshold: float = 0.8, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs: their columns in a struct `row`, the line numbers that go in `gone`, and the text without them in `kept`."""
    gone = removed_lines(id_and_text(docs, id_col, text_col), threshold, broadcast_rows)
    by_doc = stored(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "gone")
    total = by_doc.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if total[0] <= broadcast_rows and total[1] <= 8 * broadcast_rows:  # 20 bytes a document and 4 a line
        by_doc = F.broadcast(by_doc)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    joined = rows.join(by_doc, (F.col("row")[id_col].cast("long") == F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("gone", k)), "\n")
    return joined.select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept"))


def drop_similar_lines(docs: DataFrame, threshold: float = 0.8, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with texts without the lines that go; an untouched text stays as it is."""
    out = deduplicated(docs, threshold, broadcast_rows, id_col, text_col)
    row = F.col("row")
    return out.select(*[F.when(F.col("gone").isNull(), row[c]).otherwise(F.col("kept")).alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, threshold: float = 0.8, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_lines, n_removed and kept_sha256."""
    plain = id_and_text(docs, id_col, text_col)
    out = deduplicated(plain, threshold, broadcast_rows)
    n = F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1
    return out.select("row.doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB: equal sets by their sorted tokens, candidates by prefixes in order of document frequency.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM parts),
toks AS (SELECT doc_id, line_no, line, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda t: t <> ''))) AS s FROM lines),
sets AS (SELECT s, len(s) AS n, min(doc_id * 1000000 + line_no) AS place FROM toks WHERE len(s) > 0 GROUP BY s),
tok AS (SELECT place, n, unnest(s) AS t FROM sets),
freq AS (SELECT t, count(*) AS f FROM tok GROUP BY t),
ordered AS (SELECT place, n, t, row_number() OVER (PARTITION BY place ORDER BY f, t) AS k FROM tok JOIN freq USING (t)),
prefix AS (SELECT place, n, t FROM ordered WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT x.place AS x, y.place AS y FROM prefix x JOIN prefix y ON x.t = y.t AND y.place < x.place AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
gone AS (SELECT DISTINCT x FROM pairs JOIN sets a ON a.place = x JOIN sets b ON b.place = y
         WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (a.n + b.n - len(list_intersect(a.s, b.s))) - 1e-9),
marked AS (SELECT t.doc_id, t.line_no, t.line, coalesce(s.place <> t.doc_id * 1000000 + t.line_no OR s.place IN (SELECT x FROM gone), false) AS drop_it
           FROM toks t LEFT JOIN sets s ON s.s = t.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
