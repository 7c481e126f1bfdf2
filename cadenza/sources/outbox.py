"""A sink for rows that leave the engine: a sheet's webhook or a folder, written once or not at all.

Tasks put their rows into a staging folder that the driver and all executors share. Commit sends the whole batch at once and
then notes it in a ledger, so a batch that is run again sends nothing; abort takes away what was staged. Without a target nothing is sent:
a dry run, and the report says how many rows there were. A target that begins with http gets one POST of a JSON array with
the batch's name as Idempotency-Key; another is a folder that gets one file for each batch.

Options: `staging` (a shared folder), `batch` (its name), `target`, `strict` (true: a failed send fails the write; else it is only reported).
The rows' columns become the fields of a JSON object; rows of one column named value are JSON already.
"""

from __future__ import annotations

import json
import os
import shutil
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cadenza.storage import shared_dir


@dataclass
class Staged(WriterCommitMessage):
    part: int
    file: str
    rows: int


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return OutboxWriter(self.options, schema.names)


class OutboxWriter(DataSourceWriter):
    def __init__(self, options, names: list[str]):
        self.names, self.batch, self.target = names, options["batch"], options.get("target") or None
        self.strict = options.get("strict", "false").lower() == "true"
        self.root = options["staging"].removeprefix("file://").rstrip("/")
        self.staged = f"{self.root}/staged/{self.batch}"

    def write(self, iterator: Iterator) -> Staged:
        task = TaskContext.get()
        os.makedirs(self.staged, exist_ok=True)
        file, n = f"{self.staged}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with open(file, "w", encoding="utf-8") as out:
            for row in iterator:
                text = row[0] if self.names == ["value"] else json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)
                out.write(text.replace("\n", " ") + "\n")
                n += 1
        return Staged(task.partitionId(), file, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Only the files of the attempts that counted are sent."""
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        rows = sum(m.rows for m in parts)
        ledger = f"{self.root}/sent/{self.batch}"
        report = {"batch": self.batch, "rows": rows, "pushed": 0, "live": self.target is not None}
        try:
            if self.target and rows and not os.path.exists(ledger):
                self.send([m.file for m in parts])
                os.makedirs(f"{self.root}/sent", exist_ok=True)
                put(ledger, str(rows))
                report["pushed"] = rows
        except Exception as error:  # a send that fails must not lose the caller's work, unless asked for
            report["error"] = f"{type(error).__name__}: {error}"[:200]
            if self.strict:
                raise
        finally:
            shutil.rmtree(self.staged, ignore_errors=True)
            os.makedirs(f"{self.root}/reports", exist_ok=True)
            put(f"{self.root}/reports/{self.batch}", json.dumps(report))

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)

    def send(self, files: list[str]) -> None:
        if self.target.startswith("http"):
            size = 2 + sum(os.path.getsize(f) for f in files) - 1  # brackets, and commas for all but the last line feed
            request = urllib.request.Request(self.target, data=array_of(files), method="POST", headers={"Content-Type": "application/json", "Content-Length": str(size), "Idempotency-Key": self.batch})
            with urllib.request.urlopen(request, timeout=60) as answer:
                answer.read()
            return
        folder = self.target.removeprefix("file://").rstrip("/")
        os.makedirs(folder, exist_ok=True)
        partial = f"{folder}/.{self.batch}"
        with open(partial, "wb") as out:
            for file in files:
                with open(file, "rb") as part:
                    shutil.copyfileobj(part, out)
        os.replace(partial, f"{folder}/{self.batch}.jsonl")


def put(path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)


def array_of(files: list[str]) -> Iterator[bytes]:
    """The lines of files as one JSON array, a line at a time."""
    before = b"["
    for file in files:
        with open(file, "rb") as part:
            for line in part:
                yield before + line.rstrip(b"\n")
                before = b","
    yield b"]" if before == b"," else b"[]"


def push(rows: DataFrame, batch: str, target: str | None = None, staging: str | None = None, strict: bool = False) -> dict:
    """Send rows as one batch and return the report: batch, rows, pushed, live and perhaps error."""
    spark: SparkSession = rows.sparkSession
    staging = staging or f"{shared_dir(spark).rstrip('/')}/outbox"
    spark.dataSource.register(Outbox)
    rows.write.format("outbox").options(staging=staging, batch=batch, target=target or "", strict=str(strict).lower()).mode("append").save()
    with open(f"{staging.removeprefix('file://').rstrip('/')}/reports/{batch}", encoding="utf-8") as f:
        return json.load(f)
