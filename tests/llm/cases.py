"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import duckdb

SF = "/root/testdata/sf0.001"
CLASHING = "key hash node fp label a b v size at _id _key pos rank".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, part string, component string"

PASSAGE = " ".join(f"passage{k}" for k in range(70))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (6, "Café 中文 \U0001f600 <s> </s> <unk> <|endoftext|> ▁ x  y   z\r\n end"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nalpha beta gamma delta epsilon zeta eta theta iota lambda\nother line"),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsomething else here"),
    (9, "start " + PASSAGE + " stop"),
    (10, "before it all " + PASSAGE),
    (11, "start " + PASSAGE + " stop"),
    (12, "word " * 30_000),
    (13, "näher " * 400 + "İstanbul ΣΣ don't e.g. 3.14 A-Z"),
    (None, "a text without an id, one two three"),
    (None, None),
    (4, "one two three"),
    (9, "start " + PASSAGE + " stop"),
    (14, "".join(chr(97 + k % 26) for k in range(5000))),
]


def table(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    return table(spark, TEXTS)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf=SF):
    """(doc_id, text) of a provided table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def components(nodes, edges):
    """The smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        s, t = sorted((top(a), top(b)))
        root[t] = s
    return {n: top(n) for n in nodes}
