"""Resumable progress: an append-only JSON Lines log, read as a stream, whose latest record of each image counts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REGIONS

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("image", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("regions", REGIONS), T.StructField("conf", T.DoubleType()), T.StructField("iou", T.DoubleType())
    ]
)


def append(rows: DataFrame, path: str) -> None:
    """Add records to the log."""
    rows.write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last record of each image by seq."""
    return rows.groupBy("image").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "image"]), "seq").alias("r")).select("image", "r.*")


def pending(target: DataFrame, done: DataFrame) -> DataFrame:
    return target.join(done.select("image"), "image", "left_anti")


def completed(target: DataFrame, done: DataFrame) -> DataFrame:
    return target.join(done.select("image"), "image", "left_semi")


def coverage(target: DataFrame, done: DataFrame) -> DataFrame:
    """Pages done of all target pages, by source."""
    marked = target.join(done.select("image", F.lit(1).alias("hit")).distinct(), "image", "left")
    return marked.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("hit").alias("done"), F.count("*").alias("target")
    ).withColumn("complete", F.col("done") == F.col("target"))


def upsert(spark: SparkSession, log: str, state: str, checkpoint: str, seconds: float | None = None, buckets: int = 16) -> bool:
    """Fold new log records into the state table under ``state``; True if all that was there was folded in before the deadline.

    The state is kept in hash buckets of images. A batch writes, as ``batch=<id>``, only the buckets that it touches, and a run that comes
    again overwrites the same version, so a restart after a lost batch neither loses nor doubles records. Readers take each bucket's greatest
    whole version; of older ones the last is left for readers that have begun, the rest goes.
    """
    place = F.pmod(F.xxhash64("image"), F.lit(buckets)).alias("bucket")

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        touched = [r["bucket"] for r in batch.select(place).distinct().collect()]
        if not touched:
            return
        old = read_state(session, state, before=batch_id, only=touched)
        both = batch if old is None else old.select(*batch.columns).unionByName(batch)
        latest(both).select(*batch.columns, place).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={batch_id}")
        _drop_old(session, state)

    query = read_stream(spark, log).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
        return True
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def _versions(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """The whole versions of each bucket, falling."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(state)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if fs.exists(root):
        for version in fs.listStatus(root):
            name = version.getPath().getName()
            if name.startswith("batch=") and fs.exists(path(version.getPath(), "_SUCCESS")):
                for bucket in fs.listStatus(version.getPath()):
                    if bucket.getPath().getName().startswith("bucket="):
                        out.setdefault(int(bucket.getPath().getName().removeprefix("bucket=")), []).append(int(name.removeprefix("batch=")))
    return {k: sorted(v, reverse=True) for k, v in out.items()}


def _drop_old(spark: SparkSession, state: str, keep: int = 2) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, versions in _versions(spark, state).items():
        for v in versions[keep:]:
            fs.delete(path(f"{state}/batch={v}/bucket={bucket}"), True)


def read_state(spark: SparkSession, state: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """Each bucket's newest whole version (older than ``before``; of the buckets ``only``); None if there is none."""
    found = {b: [v for v in versions if before is None or v < before] for b, versions in _versions(spark, state).items() if only is None or b in only}
    paths = [f"{state}/batch={v[0]}/bucket={b}" for b, v in sorted(found.items()) if v]
    return spark.read.schema(RECORD).parquet(*paths) if paths else None


@dataclass(frozen=True)
class Stage:
    """A step of a run: ``work`` gets the records that are due (image and what the stage before recorded) and appends its own to ``log``."""

    name: str
    log: str
    state: str
    checkpoint: str
    work: Callable[[DataFrame, str], None]


def run_stages(spark: SparkSession, target: DataFrame, stages: list[Stage], seconds: float | None = None) -> dict[str, int]:
    """Run stages one after the other over what each has still to do, and fold in their logs; how many images each has done.

    A stage's targets are the images that the stage before has done, with its records; the first stage's are ``target``. Once the deadline
    has passed no further stage is begun, and a later call goes on from the states.
    """
    began, done = time.monotonic(), {}
    for stage in stages:
        left = None if seconds is None else seconds - (time.monotonic() - began)
        if left is not None and left <= 0:
            break
        state = read_state(spark, stage.state)
        due = target if state is None else pending(target, state)
        if due.limit(1).count():
            stage.work(due, stage.log)
        if log_exists(spark, stage.log):
            upsert(spark, stage.log, stage.state, stage.checkpoint, left)
        state = read_state(spark, stage.state)
        if state is None:
            break
        done[stage.name] = state.count()
        target = state
    return done


def log_exists(spark: SparkSession, log: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def partial_output(sample: DataFrame, state: DataFrame, order: str) -> DataFrame:
    """A whole submission at any time: the sample's images in order, empty where nothing is done yet."""
    got = state.select("image", "regions")
    return sample.select("image", order).join(got, "image", "left").withColumn(
        "regions", F.coalesce("regions", F.array().cast(REGIONS))
    ).orderBy(order)


def shard_of(key: str, shards: int) -> Column:
    """The number of the shard that ``key`` is in."""
    return F.pmod(F.xxhash64(key), F.lit(shards))


def shard(pages: DataFrame, shard_id: int, shards: int, key: str = "image") -> DataFrame:
    """Pages of one shard by hash of their name."""
    return pages.where(shard_of(key, shards) == shard_id)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; on a stream with a watermark. A platform capability beside the progress log."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of users by gaps, in batch: user_id, session, start, end, n."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") > gap_seconds).cast("int"), F.lit(0))
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).groupBy("user_id", "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")
    )
