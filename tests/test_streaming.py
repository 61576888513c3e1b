"""Streams over files give what batches give."""

from pyspark.sql import functions as F

from loomline.operators import growing
from loomline.streaming import usage as streams


def test_rolling_and_alerts(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i}:00:00", "t", f"k{i % 4}", 0.4, 10) for i in range(8)]
    spark.createDataFrame(rows, "seq long, timestamp string, tool string, dedup_key string, cost double, tokens long").withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streams.first_seen(source()).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 4
    q = streams.rolling_day(source()).writeStream.format("memory").queryName("rolling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rolling").agg(F.max("calls")).first()[0] == 8


def test_alerts_add_up_and_cool_down():
    from loomline.streaming import usage as streaming

    state, alert = streaming.alert_step(None, (5.0, 10, 1), 0)
    assert alert is None and state[:3] == (5.0, 10, 1)
    state, alert = streaming.alert_step(state, (5.6, 20, 2), 1)
    assert alert is None and state[0] == 5.0
    state, alert = streaming.alert_step(state, (6.1, 30, 3), 2)
    assert alert and round(alert[0], 6) == 1.1 and state == (6.1, 30, 3, 2)
    same, alert = streaming.alert_step(state, (9.0, 40, 4), 3)
    assert alert is None and same == state
    assert streaming.alert_step(state, (9.0, 40, 4), 2 + streaming.COOLDOWN_MS)[1] is not None
    assert streaming.alert_step(state, (1.0, 40, 4), 4) == ((1.0, 40, 4, 2), None)


def test_alert_stream(spark, tmp_path):
    from loomline.streaming import usage as streaming

    for i in range(3):
        spark.createDataFrame([("codex", 0.4, 10), ("gemini", 0.1, 1)], "tool string, cost double, tokens long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tool string, cost double, tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.usage_alerts(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert [(r.tool, round(r.cost, 6), r.calls) for r in spark.table("alerts").collect()] == [("codex", 1.2, 3)]


def test_batches_merge_into_one_archive(spark, tmp_path):
    """A key of an earlier batch stays one row, a repeated batch changes nothing."""
    from loomline.streaming import usage as streaming

    kinds = "seq long, tool string, dedup_key string, timestamp timestamp_ntz, timestamp_quality string, cost double, input_tokens long"
    path = str(tmp_path / "archive")
    write = streaming.merge_batches(path, buckets=4)
    first = spark.createDataFrame([(1, "codex", "a", None, "exact", 1.0, 10), (2, "codex", "a", None, "exact", 9.0, 90), (3, "cursor", "b", None, "exact", 2.0, 20)], kinds)
    second = spark.createDataFrame([(4, "codex", "a", None, "exact", 5.0, 50), (5, "cursor", "b", None, "exact", 7.0, 70), (6, "codex", "c", None, "exact", 3.0, 30)], kinds)
    write(first, 0)
    for _ in range(2):
        write(second, 1)
    got = {(r.tool, r.dedup_key): (r.cost, r.input_tokens) for r in growing.read(spark, path).collect()}
    assert got == {("codex", "a"): (1.0, 10), ("cursor", "b"): (2.0, 70), ("codex", "c"): (3.0, 30)}
