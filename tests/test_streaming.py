from pyspark.sql import functions as F

from quirelake.streaming import progress


def records(spark, rows):
    return spark.createDataFrame([(s, i, "src", [], None, None) for s, i in rows], progress.RECORD)


def test_upsert_survives_restarts(spark, tmp_path):
    log, state, cp = (str(tmp_path / x) for x in ("log", "state", "cp"))
    progress.append(records(spark, [(1, "a"), (2, "b")]), log)
    assert progress.upsert(spark, log, state, cp)
    progress.append(records(spark, [(3, "a"), (4, "c")]), log)
    assert progress.upsert(spark, log, state, cp, seconds=120)
    got = {r["image"]: r["seq"] for r in progress.read_state(spark, state).collect()}
    assert got == {"a": 3, "b": 2, "c": 4}
    assert progress.upsert(spark, log, state, cp)
    assert progress.read_state(spark, state).count() == 3


def test_partial_output_and_pending(spark):
    sample = spark.createDataFrame([("b", 0), ("z", 1), ("a", 2)], "image string, n int")
    done = records(spark, [(1, "a"), (2, "b")])
    assert [(r["image"], len(r["regions"])) for r in progress.partial_output(sample, done, "n").collect()] == [("b", 0), ("z", 0), ("a", 0)]
    assert [r["image"] for r in progress.pending(sample, done).collect()] == ["z"]
    assert progress.completed(sample, done).count() == 2
    parts = [progress.shard(sample, i, 3).count() for i in range(3)]
    assert sum(parts) == 3


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.createDataFrame(
        [(i, i * 600, "e", 1.0) for i in range(12)], "event_id long, s long, event_type string, value double"
    ).select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = progress.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [6, 6]
