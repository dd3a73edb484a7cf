"""Token-id files: shards of concatenated ids in ascending document order, with Elias-Fano boundaries, and their reader.

A shard's name is drawn for the attempt of the task that writes it, and the manifest, a table beside the shards, names those of the attempts
that succeeded. So a task that runs again leaves at most files that nobody reads. Neither ids nor the manifest come to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .eliasfano import Shard, pack_shard
from .scratch import fresh_path
from .words import portions

END_ID = 2
SHARD_IDS = 4_000_000
#: Shards that one task reads back.
SHARDS_A_TASK = 4


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, uri: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode each text, append ``end_id`` and write shards of about ``shard_ids`` ids under ``uri``, in ascending order of id.

    Returns the manifest, a table written to ``uri``/manifest: a row for each shard with its name and counts and the ids before it. A null text
    is empty and has the end id alone; rows of a null id come first; equal ids follow each other in order of their text's hash; an empty
    table gives an empty manifest; other columns are not read. A document longer than a shard has one of its own; a very long text is
    encoded in parts. Only one shard's ids are held at a time.
    """
    width = 2 if tokens.load(tokenizer).n_vocab <= 65536 and end_id < 65536 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokens.load(tokenizer), TaskContext.get().partitionId()
        ids, pieces, held, seq = [], [], 0, 0
        store, path = _store(uri)
        store.create_dir(path, recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.qlt"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(pack_shard(ids, [len(p) for p in pieces], np.concatenate(pieces), width))
            row = [[name], [part], [seq], [len(ids)], [held]]
            ids.clear()
            pieces.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0]), *(pa.array(x, pa.int64()) for x in row[1:])], names=["name", "part", "seq", "n_docs", "n_ids"]
            )

        for b in portions(batches, 1):
            for doc, found in zip(b.column(0).to_pylist(), tok.many(b.column(1)), strict=True):
                got = np.append(found, np.int32(end_id)).astype(np.uint16 if width == 2 else np.uint32)
                if ids and held + len(got) > shard_ids:
                    yield flush()
                ids.append(doc)
                pieces.append(got)
                held += len(got)
        if ids:
            yield flush()

    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")
    ).withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "h", "m").sortWithinPartitions("id", "h", "m")
    rows.select("id", "text").mapInArrow(run, "name string, part long, seq long, n_docs long, n_ids long").write.parquet(f"{uri}/written")
    written = spark.read.parquet(f"{uri}/written")
    # ids before each task's shards, by one row a task; then within the task
    order = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = written.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(order.orderBy("part")), F.lit(0)).alias("first")
    )
    inside = F.coalesce(F.sum("n_ids").over(order.partitionBy("part").orderBy("seq")), F.lit(0))
    written.join(tasks, "part").select("name", "n_docs", "n_ids", (F.col("first") + inside).alias("before")).write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the shards of ``manifest``; a shard that is missing or cut short is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(uri)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}") as file:
                    s = Shard(file.read())
                which = np.arange(s.n_docs)
                start, end = s.bounds.select_many(which), s.bounds.select_many(which + 1)
                crcs = [tokens.crc(s.ids[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids(), pa.int64()), pa.array(start + before), pa.array(end - start), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = manifest.count()
    files = manifest.select("name", "before").repartition(max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // SHARDS_A_TASK)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids_round_trip(docs: DataFrame, tokenizer: str | None = None, uri: str | None = None) -> DataFrame:
    """Write token files for ``docs`` (columns doc_id and text) and read them back."""
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "token-files")
    return read_token_files(spark, uri, write_token_files(docs, uri, tokenizer or tokens.default_path()))
