"""Titles and even splits take the beats of every conversation, and first turns as they are."""

from cadenza.plans import registry


def test_no_conversation_is_left_out(spark, tmp_path):
    rows = [(c, t, "user", "one two three four five six seven eight") for c in (12, 14, 25, 28) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    titles = {(r.ticket_id, r.order_index) for r in registry.queries()["title_spans"](spark, str(tmp_path)).collect()}
    assert titles == {(c, t) for c, t, *_ in rows}
    split = registry.queries()["even_split"](spark, str(tmp_path)).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in split} == {c * 1000 + t: 8 for c, t, *_ in rows}
