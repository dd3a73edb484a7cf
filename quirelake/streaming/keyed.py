"""Progress as chained streams with keyed state: what each image's newest record is stands in the state store, not in files that are rewritten.

A stage reads the log of the stage before as a stream, keeps each image's greatest seq in state, and appends what its work makes of newer
records to its own log by the file sink, whose batches count once however often they are run. The log of one stage is the source of the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .progress import RECORD, latest

#: Keyed state of any size: it is kept on executors' disks and its changes in the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN = T.StructType([T.StructField("seq", T.LongType())])


class Newest(StatefulProcessor):
    """Passes on an image's record of a batch with the greatest seq, if no earlier batch had as great a one. Records without seq are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            frame = frame.dropna(subset=["seq"])
            if len(frame):
                row = frame.loc[[frame["seq"].idxmax()]]
                if best is None or row["seq"].iloc[0] > best["seq"].iloc[0]:
                    best = row
        if best is None:
            return
        seq = int(best["seq"].iloc[0])
        if not self.seen.exists() or seq > self.seen.get()[0]:
            self.seen.update((seq,))
            yield best

    def close(self) -> None:
        pass


def newest(records: DataFrame) -> DataFrame:
    """A stream of the records (image, seq and others) that were their image's newest when they came. Records without an image are one image's."""
    return records.groupBy("image").transformWithStateInPandas(Newest(), records.schema, "Append", "None")


@dataclass(frozen=True)
class Link:
    """A step of a chain: ``work`` turns the newest records of the stage before (a stream) into its own, of image, seq and what it adds."""

    name: str
    work: Callable[[DataFrame], DataFrame] = lambda records: records


def start(spark: SparkSession, source: str, root: str, links: list[Link], schema: T.StructType = RECORD, files_per_batch: int = 100) -> list[StreamingQuery]:
    """Start a chain over the JSON Lines log ``source``; each link's log and checkpoint are under ``root``/its name. Each query handles what is there.

    A link's stream sees what the links before had committed when it was started, so queries that are awaited one after the other pass everything
    on; those that run side by side pass on the rest at the next start. After a kill, the same call goes on where the checkpoints are.
    """
    queries, records = [], spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    for link in links:
        log = f"{root}/{link.name}/log"
        out = link.work(newest(records))
        queries.append(_append(spark, out, log, f"{root}/{link.name}/checkpoint"))
        records = _stream_of(spark, log, out.schema, files_per_batch)
    return queries


def run(spark: SparkSession, source: str, root: str, links: list[Link], schema: T.StructType = RECORD, files_per_batch: int = 100) -> None:
    """The chain's links one after the other, each over all that the one before has committed."""
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    for link in links:
        log = f"{root}/{link.name}/log"
        out = link.work(newest(records))
        _append(spark, out, log, f"{root}/{link.name}/checkpoint").awaitTermination()
        records = _stream_of(spark, log, out.schema, files_per_batch)


def _stream_of(spark: SparkSession, log: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)


def _append(spark: SparkSession, rows: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends what there is. It takes the settings of its start with it, so the session's own store comes back at once."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", log).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def state(spark: SparkSession, root: str, link: str) -> DataFrame:
    """Each image's newest record in a link's log. Only committed batches are read."""
    return latest(spark.read.parquet(f"{root}/{link}/log"))


def seen(spark: SparkSession, root: str, link: str) -> DataFrame:
    """image and seq, read from the link's state store itself."""
    rows = spark.read.format("statestore").option("path", f"{root}/{link}/checkpoint").option("stateVarName", "seen").load()
    return rows.select(F.col("key.image").alias("image"), F.col("value.seq").alias("seq"))
