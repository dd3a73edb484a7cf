"""Ranked lexical search as a blocked sparse matrix product.

One matrix holds how often each item has each term (or whether it has it), the other the impact of each term in each document, whole numbers.
Items come in blocks of bounded bytes, documents in portions of text. In a portion the impacts are sorted into rows of terms; an item's row of
the product merges the rows of its terms in an accumulator over the portion's documents, and only the best few of it leave the portion. A first
pass over the texts counts what the weights need: documents, terms and, for the items' terms, the documents that have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import alnum_words, portions, row_texts

#: Bytes of item texts whose terms are held at a time; more items are searched for in blocks, each with a pass over the documents.
MOST_BYTES = 16_000_000
#: Parts in which an item's best documents are merged before they are merged as a whole.
PARTS = 64


@dataclass
class Items:
    """A block of items as sparse rows: terms ``at[i]:at[i + 1]`` of ``terms`` and how often, for the i-th of ``rows``."""

    rows: list[int]
    vocabulary: dict[bytes, int]
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def item_rows(items: list[tuple[int, str | None]], once: bool = True) -> Items:
    """Sparse rows of (row number, text); with ``once`` a term counts once an item, else as often as it occurs."""
    vocabulary: dict[bytes, int] = {}
    at, terms, times = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words((text or "").encode())]
        own, n = np.unique(np.array(found, np.int64), return_counts=True)
        terms.append(own)
        times.append(np.ones(len(own), np.int64) if once else n.astype(np.int64))
        at.append(at[-1] + len(own))
    return Items([r for r, _ in items], vocabulary, np.array(at), np.concatenate(terms), np.concatenate(times))


def term_frequencies(texts: Iterator[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a portion of texts: how many terms each has, and (text, term, occurrences) of the vocabulary's terms, sorted by term."""
    known, numbers, lengths, unknown = vocabulary.get, [np.zeros(0, np.int64)], [], len(vocabulary)
    for t in texts:
        words = alnum_words(t)
        lengths.append(len(words))
        numbers.append(np.fromiter(map(known, words, repeat(unknown)), np.int64, len(words)))
    n = np.array(lengths, np.int64)
    words, owner = np.concatenate(numbers), np.repeat(np.arange(len(n)), n)
    mine = words < unknown
    cells, tf = np.unique(words[mine] * max(1, len(n)) + owner[mine], return_counts=True)
    return n, cells % max(1, len(n)), cells // max(1, len(n)), tf.astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``n`` terms, in 64-bit whole numbers; divisions round down."""
    m = 100 - 90 + (90 * n * documents) // max(1, total)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def term_weight(documents: int, having: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in having.tolist()], np.int64)


def best_of_block(items: Items, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of each item's ``top`` documents of the block, by score and then by place; the entries are sorted by term."""
    bounds = np.searchsorted(term, np.arange(len(items.vocabulary) + 1))
    sums = np.zeros(n_docs, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(items.rows)):
        touched = []
        for k in range(items.at[i], items.at[i + 1]):
            row = slice(bounds[items.terms[k]], bounds[items.terms[k] + 1])
            if row.start < row.stop:
                sums[doc[row]] += items.times[k] * impact[row]  # a document stands once in a term's row
                touched.append(doc[row])
        if not touched:
            continue
        seen = np.flatnonzero(sums)
        score = sums[seen]
        if len(seen) > top:  # all that reach the last place's score, then by place among equals
            least = np.partition(score, len(score) - top)[len(score) - top]
            near = score >= least
            seen, score = seen[near], score[near]
        order = np.lexsort((seen, -score))[:top]
        out.append((np.full(len(order), i), seen[order], score[order]))
        sums[:] = 0
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none)


def _blocks(items: DataFrame, item_col: str, text_col: str, most_bytes: int) -> Iterator[tuple[DataFrame, list[tuple[int, str | None]]]]:
    """Blocks of items: their rows, and (hash of the row, text) of each. Items of the same id and text are one."""
    rows = items.select(items[item_col].alias("item"), items[text_col].cast("string").alias("text")).distinct().withColumn("key", F.xxhash64(F.col("item").cast("string"), F.col("item").isNull(), "text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / most_bytes))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k)
        yield block, [(r["key"], r["text"]) for r in block.select("key", "text").collect()]


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, once: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """The ``top`` documents of each item: the item's id, rank (from 1), the document's id, score. Only scores above 0 are ranked.

    Terms are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. Null and empty texts have no term, on either side, and
    appear nowhere; a very long text is read whole. Equal scores are ordered by ascending document id, null ids first; rows that repeat count
    each and may each be ranked. Items that repeat id and text are one; an id with several texts has as many lists. A table without documents
    or items gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = spark.createDataFrame([], f"item {item_kind}, rank int, id {doc_kind}, score long")
    for block, texts in _blocks(items, item_col, item_text_col, most_bytes):
        held = spark.sparkContext.broadcast(item_rows(texts, once))
        documents, total, weight = _statistics(plain, held)
        found = plain.mapInArrow(_product(held, documents, total, weight, top), f"key long, id {doc_kind}, score long")
        ranked = found.withColumn("part", F.pmod(F.xxhash64("id", "score"), F.lit(PARTS)))
        for by in (["key", "part"], ["key"]):
            best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
            ranked = ranked.withColumn("rank", best).where(F.col("rank") <= top)
        # at most ``top`` rows an item meet the block's few items
        out = out.unionByName(ranked.select("key", "rank", "id", "score").join(block.select("key", "item"), "key").select("item", "rank", "id", "score"))
    return out.withColumnsRenamed({"item": item_col, "id": id_col if id_col != item_col else f"doc_{id_col}"})


def _statistics(plain: DataFrame, held) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and each vocabulary term's weight. What comes back is bounded by the block's vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value.vocabulary
        having, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for b in portions(batches, 0):
            n, _, term, _ = term_frequencies(row_texts(b.column(0)), vocabulary)
            having += np.bincount(term, minlength=len(vocabulary))
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        seen = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[documents, total], having[seen]]))], names=["term", "n"]
        )

    counts = {t: n for t, n in plain.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = counts.pop(-2, 0), counts.pop(-1, 0)
    having = np.zeros(len(held.value.vocabulary), np.int64)
    having[np.array(list(counts), np.int64)] = list(counts.values())
    return documents, total, term_weight(documents, having)


def _product(held, documents: int, total: int, weight: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        keys = np.array(items.rows, np.int64)
        for b in portions(batches, 1):
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))  # so that the place in the block follows the id
            n, doc, term, tf = term_frequencies(row_texts(b.column(1)), items.vocabulary)
            who, where, score = best_of_block(items, doc, term, impacts(tf, n[doc], weight[term], documents, total), len(n), top)
            yield pa.RecordBatch.from_arrays([pa.array(keys[who]), b.column(0).take(pa.array(where)), pa.array(score)], names=["key", "id", "score"])

    return run
