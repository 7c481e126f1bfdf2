"""Operator 11: archives written, deduplicated and read back."""

import gzip
import hashlib
import pathlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cadenza.llm import archives, queries

from . import cases

SCHEMA = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in ["record_id", "payload", "first", "uri", *cases.CLASHING])
LONG = "long payload " * 20
ROWS = [
    (1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "http://a/4", "short"),
    (9, "http://a/9", LONG), (5, "http://a/5\r\nWARC-Type: x", LONG), (7, "http://a/7", LONG), (5, "http://a/5", LONG), (None, "http://n", LONG),
    (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "y" * 100), (14, "u", "y" * 100),
    (20, "u", "\r\n\r\n"), (21, "u", "\r\n\r\n\r\n\r\n" * 40), (22, "u", "\r\n\r\n\r\n\r\n" * 40), (23, "u", "a\r\n\r\r\n\r\nb\r\n" * 30), (24, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 9),
    (25, "u", "\n\r\n\r" * 50), (26, "u", "é中\U0001f600\x00\x85" * 40), (27, "u", "é中\U0001f600\x00\x85" * 40), (28, "u", "big " * 500_000), (29, "u", "big " * 500_000),
    (None, "u", "only without an id" * 9), (None, "u", "only without an id" * 9),
]


def by_force(rows, least=100):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = Counter()
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= least
            out[(i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None, True)] += 1
    return out


def pages(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", "f", "u", *cases.CLASHING) for r in rows], SCHEMA)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_odd_pages(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert rows_of(archives.deduplicated_pages(pages(spark, ROWS).repartition(5))) == by_force(ROWS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    assert archives.deduplicated_pages(pages(spark, [])).collect() == []


def test_files_are_warc(spark, tmp_path):
    """Read by a plain parser: records end where Content-Length says, revisits have no payload and name a response."""
    archives.deduplicated_pages(pages(spark, ROWS).coalesce(2), folder=str(tmp_path))
    seen = []
    for file in pathlib.Path(tmp_path, "deduplicated").glob("part-*.gz"):
        raw = gzip.decompress(file.read_bytes())
        at = 0
        while at < len(raw):
            head, at = raw[at : raw.index(b"\r\n\r\n", at)].decode().split("\r\n"), raw.index(b"\r\n\r\n", at) + 4
            assert head[0] == "WARC/1.1"
            said = dict(line.split(": ", 1) for line in head[1:])
            assert len(said) == len(head) - 1  # no field twice
            block = raw[at : at + int(said["Content-Length"])]
            at += len(block)
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
            seen.append((said, block.partition(b"\r\n\r\n")[2]))
    assert len(seen) == len(ROWS)
    responses = {s["WARC-Record-ID"]: (s, body) for s, body in seen if s["WARC-Type"] == "response"}
    for said, body in seen:
        assert len({"WARC-Date", "WARC-Payload-Digest", "Content-Type"} & set(said)) == 3
        if said["WARC-Type"] == "revisit":
            first, payload = responses[said["WARC-Refers-To"]]
            assert body == b"" and said["WARC-Profile"].endswith("identical-payload-digest")
            assert said["WARC-Payload-Digest"] == first["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            assert said["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] and said["WARC-Refers-To-Date"] == first["WARC-Date"]
    assert "http://a/5%0D%0AWARC-Type:%20x" in {s.get("WARC-Target-URI") for s, _ in seen}


def test_again_and_unresolved(spark, tmp_path):
    """Deduplicated archives may be deduplicated again; a revisit without its response has no size; a cut archive is an error."""
    archives.deduplicated_pages(pages(spark, ROWS), folder=str(tmp_path))
    archives.deduplicate(spark, f"{tmp_path}/deduplicated", f"{tmp_path}/again")
    assert rows_of(archives.resolved(spark, f"{tmp_path}/again")) == by_force(ROWS)
    head = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x>\r\nWARC-Refers-To: <urn:gone>\r\nContent-Length: 0\r\n\r\n"
    (tmp_path / "alone").mkdir()
    (tmp_path / "alone" / "a.warc.gz").write_bytes(gzip.compress((head + "\r\n\r\n").encode()))
    assert [tuple(r) for r in archives.resolved(spark, f"{tmp_path}/alone").collect()] == [(None, None, None, "revisit", None, None)]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(head.replace("Content-Length: 0", "Content-Length: 500").encode() + b"few"))
    with pytest.raises(Exception, match="ends inside a record"):
        archives.read_archives(spark, f"{tmp_path}/cut").collect()


def test_records_of_members(spark, tmp_path):
    """One gzip member a record, as crawlers write, and blocks that aren't http."""
    one = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{0}>\r\nContent-Length: {1}\r\n\r\n{2}\r\n\r\n"
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(one.format(k, 3 * k, "abc" * k).encode()) for k in range(5)))
    got = archives.read_archives(spark, str(tmp_path)).select("record_id", "payload").collect()
    assert sorted((r[0], bytes(r[1])) for r in got) == [(f"urn:{k}", b"abc" * k) for k in range(5)]


def test_query(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{cases.SF}/pages.parquet'").fetchall()
    assert rows_of(queries.op11_warc(spark, cases.SF)) == by_force(rows)
