"""Batches leave once or not at all."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from cadenza.sources import outbox
from cadenza.streaming import perf


@pytest.fixture
def sheet():
    """A webhook that takes or refuses batches."""
    got, state = [], {"status": 200}

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if state["status"] == 200:
                got.append((self.headers["Idempotency-Key"], json.loads(body)))
            self.send_response(state["status"])
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/hook", got, state
    server.shutdown()


def test_a_batch_is_sent_once(spark, tmp_path, sheet):
    url, got, state = sheet
    rows = spark.range(7).select("id", F.concat(F.lit("é\n\""), "id").alias("t")).repartition(3)
    push = lambda **kw: outbox.push(rows, "one", url, str(tmp_path), **kw)
    state["status"] = 500
    assert push()["error"].startswith("HTTPError") and not got
    with pytest.raises(Exception, match="HTTP Error 500"):
        push(strict=True)
    state["status"] = 200
    assert push() == {"batch": "one", "rows": 7, "pushed": 7, "live": True}
    assert push()["pushed"] == 0
    (key, sent), = got
    assert key == "one" and sorted(r["id"] for r in sent) == list(range(7)) and {r["t"] for r in sent} == {f'é\n"{k}' for k in range(7)}
    assert not os.path.exists(tmp_path / "staged" / "one")


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(20, numPartitions=4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken row"):
        outbox.push(rows, "bad", str(tmp_path / "out"), str(tmp_path / "staging"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "staging" / "sent").exists()
    # what tasks staged after the failure goes with the next try of the batch, which sends its own rows only
    assert outbox.push(spark.range(2).select(F.col("id").cast("string").alias("value")), "bad", str(tmp_path / "out"), str(tmp_path / "staging"))["pushed"] == 2
    assert (tmp_path / "out" / "bad.jsonl").read_text().split() == ["0", "1"] and not (tmp_path / "staging" / "staged" / "bad").exists()


def test_nothing_to_send_and_dry_runs(spark, tmp_path, sheet):
    url, got, _ = sheet
    none = spark.range(0).select(F.col("id").cast("string").alias("value"))
    assert outbox.push(none, "none", url, str(tmp_path)) == {"batch": "none", "rows": 0, "pushed": 0, "live": True}
    assert outbox.push(spark.range(3), "dry", None, str(tmp_path)) == {"batch": "dry", "rows": 3, "pushed": 0, "live": False}
    assert not got


def test_a_stream_of_facts_reaches_the_sheet_once(spark, tmp_path, sheet):
    url, got, _ = sheet
    fact = lambda k: json.dumps({"id": k, "video_kind": "reel", "video_id": k, "platform": "tt", "views": k, "follows": 0, "saves": 0, "sends": 0, "captured_at": f"2024-01-0{k}T00:00:00Z"})
    (tmp_path / "in").mkdir()
    videos = spark.createDataFrame([("reel", 1, "en", "h", "a", "")], "kind string, vid long, brand string, hook string, angle string, caption_style string")
    (tmp_path / "in" / "a.json").write_text("\n".join([fact(2), fact(1)]))
    run = lambda ck: perf.start_pushes(perf.facts(spark, str(tmp_path / "in")), videos, url, str(tmp_path / "staging"), str(tmp_path / ck)).awaitTermination()
    run("ck")
    run("lost")  # a checkpoint that was lost: the first batch is run again
    assert [(k, [r["views"] for r in rows]) for k, rows in got] == [("facts-0", [1, 2])]
    (tmp_path / "in" / "b.json").write_text(fact(3))
    run("ck")
    assert [(k, [r["views"] for r in rows]) for k, rows in got] == [("facts-0", [1, 2]), ("facts-1", [3])]
