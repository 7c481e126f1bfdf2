r"""Operator 11: WARC archives of pages, without payloads that are already held.

Archives are gzip text files whose lines end in CR LF CR LF, which is how a WARC record ends, so Spark's own writer
with its commits makes them on any file system, and a file is read as a stream of pieces that are put together by Content-Length; nothing
holds a whole file, and a payload may hold the separator. Each file is read by one task, as gzip isn't split; files are as many as the partitions written.

Revisits are resolved with headers alone: first all pages are written as responses, each under an id of its own. Their headers
(id, digest, size) are shuffled by digest, the first page of each digest of which there are more is kept, and all others' ids are
told which record they revisit. The archives are rewritten with fresh headers, revisits without payload. A read
joins revisits to the responses that they name. Payloads move only where more ids are to be rewritten than Spark broadcasts
(spark.sql.autoBroadcastJoinThreshold); then records are joined by their ids, which are unique.

Defined results: a null html is an empty payload; payloads under `least` bytes are always responses; of rows with equal page_id and
payload one is the response; a null page_id comes after all others and is null in refers_to; a null url has no WARC-Target-URI, and controls and spaces in a
url are percent-encoded. An archive that ends inside a record is an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_dir, stored

END = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to string, refers_uri string, refers_date string, declared_digest string, payload_bytes long, payload_digest string, payload binary"


def safe_uri(url: Column) -> Column:
    """Controls and spaces percent-encoded: nothing in a url ends a header."""
    found = url
    for code in [*range(33), 127]:
        found = F.replace(found, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), found).otherwise(url)


def lines(**fields: Column | str) -> Column:
    """Header lines; a field whose value is null has none."""
    made = [F.concat(F.lit(f"\r\n{name.replace('_', '-')}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in fields.items()]
    return F.concat_ws("", *made)


def record(kind: Column, record_id: Column, uri: Column, page_id: Column, payload: Column, size: Column, digest: Column, date: Column, **refers: Column) -> Column:
    """A whole record but for its end; a revisit has the head of the answer and no payload. A size that is null isn't told."""
    revisit = kind == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), lines(Content_Length=size.cast("string")), F.lit(END))
    length = F.octet_length(head) + F.when(revisit, 0).otherwise(size)
    said = lines(
        WARC_Type=kind,
        WARC_Record_ID=F.concat(F.lit("<"), record_id, F.lit(">")),
        WARC_Date=date,
        WARC_Target_URI=uri,
        WARC_Payload_Digest=F.concat(F.lit("sha256:"), digest),
        WARC_Profile=F.when(revisit, REVISIT_PROFILE),
        X_Page_ID=page_id.cast("string"),
        **refers,
        Content_Type="application/http; msgtype=response",
        Content_Length=length.cast("string"),
    )
    return F.concat(F.lit(VERSION), said, F.lit(END), head, F.when(revisit, "").otherwise(payload))


def write_archives(records: DataFrame, path: str) -> None:
    """records is one column of record texts; a file for each partition."""
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """A response for each page, with an id of its own."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), safe_uri(F.col("url")).alias("uri"), payload.alias("payload"), F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"))
    size, digest = F.octet_length("payload"), F.sha2("payload", 256)
    now = F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    write_archives(plain.select(record(F.lit("response"), F.col("record_id"), F.col("uri"), F.col("page_id"), F.col("payload"), size, digest, now)), path)


def parse(head: bytes) -> dict[str, str]:
    first, *fields = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:80]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (f.partition(":") for f in fields)}


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream that was cut at END."""
    end = END.encode()
    held, head = bytearray(), None
    for piece in pieces:
        held += piece
        held += end
        while True:
            if head is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                at = held.find(end)
                if at < 0:
                    break
                head = parse(bytes(held[:at]))
                del held[: at + 4]
            size = int(head["content-length"])
            if len(held) < size + 4:
                break
            yield head, bytes(held[:size])
            del held[: size + 4]
            head = None
    if head is not None or held.strip():
        raise ValueError("the archive ends inside a record")


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    if head["warc-type"] == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(END.encode())[2]
    return block


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record; sizes and digests are those of the payload as read, null for revisits. Without `payloads` that column is null."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("refers_uri", pa.string()), ("refers_date", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        pieces = (piece.as_py() for batch in batches for piece in batch.column(0))
        for head, block in records_of(pieces):
            body = payload_of(head, block)
            page, refers = head.get("x-page-id"), head.get("warc-refers-to")
            told = (None, None) if body is None else (len(body), hashlib.sha256(body).hexdigest())
            digest = head.get("warc-payload-digest", "").partition(":")[2] or None
            row = (head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-date"), page and int(page), refers and refers.strip("<>"), head.get("warc-refers-to-target-uri"), head.get("warc-refers-to-date"), digest, *told, body if payloads else None)
            rows.append(row)
            size += len(block) if payloads else 200
            if size > batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(read, SCHEMA)


def revisits(heads: DataFrame, least: int) -> DataFrame:
    """(record_id, first): for each record whose payload an earlier page has, that page's record. Revisits are told the first page too, by the digest that they declare."""
    given = heads.withColumn("digest", F.coalesce("payload_digest", "declared_digest"))
    response = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least)
    given = given.where(response | (F.col("record_type") == "revisit"))
    first = F.min(F.when(response, F.struct(F.col("page_id").isNull().alias("late"), "page_id", "record_id", "target_uri", "date")))
    # stored apart from the join, so that the records of a very common payload can be split there
    firsts = stored(given.groupBy("digest").agg(first.alias("first"), F.count("*").alias("held")).where("held > 1 and first is not null").drop("held"), "firsts")
    return stored(given.join(firsts, "digest").where("record_id <> first.record_id").select("record_id", "first"), "revisits")


def deduplicate(spark: SparkSession, path: str, to: str, least: int = 100) -> None:
    """Rewrite the archives under `path`: of equal payloads of at least `least` bytes the first page's is kept, the others become revisits of it."""
    heads = stored(read_archives(spark, path, payloads=False).drop("payload"), "heads")
    told = read_archives(spark, path).join(revisits(heads, least), "record_id", "left")
    named = F.col("first").isNotNull()
    kind = F.when(named, "revisit").otherwise(F.col("record_type"))
    to_id = F.coalesce("first.record_id", "refers_to")
    refers = {
        "WARC_Refers_To": F.concat(F.lit("<"), to_id, F.lit(">")),
        "WARC_Refers_To_Target_URI": F.when(named, F.col("first.target_uri")).otherwise(F.col("refers_uri")),
        "WARC_Refers_To_Date": F.when(named, F.col("first.date")).otherwise(F.col("refers_date")),
    }
    digest = F.coalesce("payload_digest", "declared_digest")
    write_archives(told.select(record(kind, F.col("record_id"), F.col("target_uri"), F.col("page_id"), F.col("payload").cast("string"), F.col("payload_bytes"), digest, F.col("date"), **refers)), to)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Each record of an archive with the size and digest of its full payload, and the page that a revisit refers to.

    A revisit whose response isn't in the archive has a null size and digest. `intact` tells whether the digest is the one that its header declares.
    """
    heads = stored(read_archives(spark, path, payloads=False).drop("payload"), "heads")
    held = heads.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("held_page"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    size, digest = F.coalesce("payload_bytes", "held_bytes"), F.coalesce("payload_digest", "held_digest")
    return heads.join(held, "refers_to", "left").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("held_page").alias("refers_to"), (digest == F.col("declared_digest")).alias("intact"))


def deduplicated_pages(pages: DataFrame, least: int = 100, folder: str | None = None) -> DataFrame:
    """Write archives of pages (page_id, url, html), deduplicate them and read the result: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_pages(pages, f"{folder}/captured")
    deduplicate(spark, f"{folder}/captured", f"{folder}/deduplicated", least)
    return resolved(spark, f"{folder}/deduplicated")


#: The same rows in DuckDB, from the pages themselves.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN first END AS refers_to, true AS intact
FROM ranked
"""
