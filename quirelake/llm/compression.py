"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses far below ordinary prose and random bytes hardly at all. How far prose goes depends on its length, so limits are set per length band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Numbering, portions, row_texts, spaced_words, windows_repeated

#: Bytes from which a band holds, least and greatest compressed share of it. Texts under the first band are too short for a verdict.
BANDS = (
    (64, 0.45, 1.40), (128, 0.40, 1.15), (256, 0.36, 1.00), (512, 0.33, 0.90), (1024, 0.31, 0.85), (2048, 0.30, 0.80), (4096, 0.28, 0.78),
    (16384, 0.26, 0.76)
)
SYMBOLS = b"#*$%&|<>"

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, doc_ratio double, n_chunks long, n_bad_chunks long, reason string"


@dataclass(frozen=True)
class Limits:
    """level: zstandard's. chunk: bytes in a chunk; bad_chunks: share of a document's chunks outside their band from which it is rejected."""

    level: int = 3
    chunk: int = 1024
    bad_chunks: float = 0.5
    bands: tuple = BANDS
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def band_verdict(size: int, ratio: float, bands: tuple = BANDS) -> str:
    """'' inside the band, else why not."""
    found = ""
    for least, low, high in bands:
        if size < least:
            break
        found = "repetitive" if ratio < low else "incompressible" if ratio > high else ""
    return found


def code_points(b: bytes) -> int:
    return int((np.frombuffer(b, np.int8) >= -64).sum()) if b else 0


def measure(text: bytes, limits: Limits, z: zstandard.ZstdCompressor) -> tuple:
    words = spaced_words(text)
    n = len(words)
    spaces = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen, dup_lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += bool(line.split())
        else:
            seen.add(line)
    repeat = windows_repeated(Numbering().of(words), limits.window)
    failed = n < limits.least_words or 100 * repeat > limits.repeat_percent * n
    ratio = len(z.compress(text)) / len(text) if text else 1.0
    chunks = [text[i : i + limits.chunk] for i in range(0, len(text), limits.chunk)]  # the last one, shorter, has the limits of its length
    bad = sum(bool(band_verdict(len(c), len(z.compress(c)) / len(c), limits.bands)) for c in chunks) if len(chunks) > 1 else 0
    why = "base" if failed else band_verdict(len(text), ratio, limits.bands)
    if not why and len(chunks) > 1 and bad >= limits.bad_chunks * len(chunks):
        why = "chunks"
    return n, code_points(text) - spaces, sum(
        text.count(s) for s in (bytes([c]) for c in SYMBOLS)
    ), dup_lines, repeat, failed, not why, ratio, len(chunks), bad, why


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: its id and METRICS. ``reason`` is empty for kept rows, else base, repetitive, incompressible or chunks.

    A null text is measured as empty, and so has no words and fails the base rule; very long texts are measured whole, as one document and in
    all their chunks; ids may be null or repeat, each row is judged alone; an empty table gives an empty result; other columns are not read.
    """
    schema = f"{docs.select(id_col).schema.simpleString()[7:-1].split(':', 1)[1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=limits.level)
        for b in portions(batches, 1):
            rows = [measure(t, limits, z) for t in row_texts(b.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, KINDS, strict=True))], names=["id", *NAMES])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {schema}, {METRICS}")
    return out.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns as they are.

    Null and empty texts go, as they have no words; a very long text is judged whole; repeated rows are judged alike, each by itself; ids
    don't matter; an empty table stays empty. Only the texts go to Python, and one verdict a row comes back.
    """

    @F.arrow_udf("boolean")
    def kept(column: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=limits.level)
        return pa.array([measure(t, limits, z)[6] for t in row_texts(column)], pa.bool_())

    return docs.where(kept(F.col(text_col)))


NAMES = [x.split()[0] for x in METRICS.split(", ")]
KINDS = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in METRICS.split(", ")]
