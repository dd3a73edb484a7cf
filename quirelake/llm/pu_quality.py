"""Quality classifier by positive-unlabelled learning.

Trusted positives and all unlabelled text give a linear model over indicator features of the text; labels of bad quality are not used. With
the squared loss the non-negative unbiased risk depends on the data only through first and second moments of the features, so one
distributed pass over all rows suffices, and descent on the risk runs over matrices of fixed size. The class prior comes from the same rows:
the share of unlabelled rows scored above a threshold over that of positives, at the threshold where its confidence bound is least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .words import Numbering, portions, row_texts, spaced_words

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_HIGH = np.arange(256) >= 128
_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
_COMMON = np.array([c in b".,;:'\"()-?" for c in range(256)])
_ODD = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _COMMON)
#: Each statistic and the values above which its indicators are set.
KNOTS: dict[str, tuple[float, ...]] = {
    "log_bytes": (2, 3, 4, 5, 6, 7, 8, 9),
    "odd_share": (0.002, 0.01, 0.03, 0.08, 0.2),
    "upper_share": (0.02, 0.06, 0.15, 0.4, 0.7),
    "digit_share": (0.002, 0.02, 0.1, 0.3),
    "common_share": (0.002, 0.01, 0.05, 0.1),
    "space_share": (0.05, 0.1, 0.2, 0.3),
    "high_share": (0.01, 0.1, 0.3),
    "word_length": (2, 4, 6, 9, 15),
    "distinct_words": (0.02, 0.1, 0.25, 0.4, 0.55, 0.7, 0.9),
    "top_word": (0.05, 0.1, 0.2, 0.4),
    "repeated_next": (0.002, 0.02, 0.1, 0.3),
    "distinct_pairs": (0.05, 0.2, 0.5, 0.8, 0.95),
    "pair_loss": (0.02, 0.1, 0.3, 0.6),
    "bare_words": (0.01, 0.05, 0.2, 0.5),
    "odd_words": (0.01, 0.05, 0.2, 0.5),
    "repeated_lines": (0.02, 0.1, 0.3),
}
WIDTH = 1 + sum(map(len, KNOTS.values()))
PACKED = (WIDTH + 7) // 8
_EDGES = [(i, k) for i, ks in enumerate(KNOTS.values()) for k in ks]


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(KNOTS)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = spaced_words(text)
    m = len(words)
    letters = max(1, int(h[_UPPER].sum() + h[_LOWER].sum() + h[_HIGH].sum()))
    shares = [float(h[x].sum()) / n for x in (_ODD, _DIGIT, _COMMON, _SPACE, _HIGH)]
    if m:
        names = Numbering()
        ids = names.of(words)
        times = np.bincount(ids)
        odd = np.fromiter((not w[-1:].isalnum() and w[-1:] not in b".,;:'\"()-?" and w[-1] < 128 for w in names), bool, len(names))
        bare = np.fromiter((not any(c > 47 for c in w) for w in names), bool, len(names))
        pairs = len(np.unique(ids[:-1] * len(times) + ids[1:])) / (m - 1) if m > 1 else 1.0
        word = [
            (n - h[_SPACE].sum()) / m, len(times) / m, times.max() / m if m > 20 else 0.0, float((ids[1:] == ids[:-1]).mean()) if m > 1 else 0.0,
            pairs, 1 - pairs if m > 20 else 0.0, float(times[bare].sum()) / m, float(times[odd].sum()) / m
        ]
    else:
        word = [0.0] * 8
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [math.log2(n) - 3, shares[0], float(h[_UPPER].sum()) / letters, shares[1], shares[2], shares[3], shares[4], *map(float, word), again]


def indicators(stats: np.ndarray) -> np.ndarray:
    """0/1 features of rows of statistics; the first is always 1."""
    out = np.ones((len(stats), WIDTH), np.uint8)
    for j, (i, k) in enumerate(_EDGES, 1):
        out[:, j] = stats[:, i] > k
    return out


def _unpack(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PACKED)
    return np.unpackbits(raw, axis=1, count=WIDTH).astype(np.float64)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            bits = np.packbits(indicators(np.array([statistics(t) for t in row_texts(b.column(1))])), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "bits"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, bits binary")


def _sums(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """n, mean and second moments of the features over all rows and over trusted ones: added up per task, then by cell."""
    upper = np.triu_indices(WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {"all": np.zeros((WIDTH, WIDTH)), "trusted": np.zeros((WIDTH, WIDTH))}
        for b in batches:
            if b.num_rows:
                x, t = _unpack(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
                total["all"] += x.T @ x
                total["trusted"] += x[t].T @ x[t]
        for name, m in total.items():
            v = m[upper]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], names=["name", "cell", "v"])

    out = {}
    got = rows.select("bits", "trusted").mapInArrow(
        run, "name string, cell long, v double"
    ).groupBy("name", "cell").agg(F.sum("v").alias("v")).collect()
    for name in ("all", "trusted"):
        m = np.zeros((WIDTH, WIDTH))
        v = np.zeros(len(upper[0]))
        for r in got:
            if r["name"] == name:
                v[r["cell"]] = r["v"]
        m[upper] = v
        m = np.maximum(m, m.T)
        n = max(m[0, 0], 1e-9)
        out[name] = (m[0, 0], m[0] / n, m / n)  # the first feature is 1, so its row sums the others
    return out


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best-bin estimate from histograms of scores, ascending bins."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    slack = math.sqrt(math.log(4 / delta) / 2) * (1 / math.sqrt(n_p) + 1 / math.sqrt(n_u))
    ok = above_p > 0
    bound = (above_u[ok] + (1 + gamma) * slack) / above_p[ok]
    best = int(bound.argmin())
    return float(min(0.99, max(0.01, above_u[ok][best] / above_p[ok][best])))


def fit(stats: dict, prior: float, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights that minimise the non-negative risk with the squared loss (1 - yf)^2 / 4, by descent preconditioned with the second moments.

    prior * E_p[l(f, 1)] + max(0, E_u[l(f, -1)] - prior * E_p[l(f, -1)]): while the second term is negative, it alone is moved back.
    """
    (_, m_u, a_u), (_, m_p, a_p) = stats["all"], stats["trusted"]
    inverse = np.linalg.inv(a_u + ridge * np.eye(WIDTH))
    w = np.zeros(WIDTH)
    best, best_w = math.inf, w
    for _ in range(steps):
        u_neg = (1 + 2 * m_u @ w + w @ a_u @ w) / 4
        p_neg = (1 + 2 * m_p @ w + w @ a_p @ w) / 4
        p_pos = (1 - 2 * m_p @ w + w @ a_p @ w) / 4
        negative = u_neg - prior * p_neg
        risk = prior * p_pos + max(0.0, negative) + ridge * w @ w
        if risk < best:
            best, best_w = risk, w.copy()
        g_neg = (m_u + a_u @ w) / 2 - prior * (m_p + a_p @ w) / 2
        g_pos = prior * (a_p @ w - m_p) / 2
        g = g_pos + g_neg if negative >= 0 else -g_neg
        w = w - (0.5 if negative >= 0 else 0.1) * (inverse @ (g + 2 * ridge * w))
    return best_w


def _probability(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(f, -15, 15)))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1, bins: int = 512
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: good likelier) and predicted (1 from 0.5 on).

    ``labels`` has ``id_col`` and quality; rows labelled 1 only, outside the held fold of crc32(id), are trusted positives, and every row of
    ``docs`` is unlabelled text. A null text scores as an empty one; a null id is in no held fold and has no label; ids may repeat (an id
    labelled both ways is not trusted); without positives the prior is 0.5 and every score is the constant model's; an empty table gives an
    empty result; other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id", F.lit(True).alias("good"))
    rows = cut(features(docs, id_col, text_col), "quality-features").withColumn("held_out", held)
    rows = cut(
        rows.join(good, "id", "left").select("id", "held_out", (F.coalesce("good", F.lit(False)) & ~F.col("held_out")).alias("trusted"), "bits"),
        "quality-rows"
    )
    stats = _sums(rows)
    # which rows look like trusted ones: least squares of positives against all, for the prior's scores
    start = np.linalg.solve(stats["all"][2] + stats["trusted"][2] + 1e-3 * np.eye(WIDTH), stats["trusted"][1] - stats["all"][1])
    span = float(np.abs(start).sum()) or 1.0

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, bins), np.int64)
        for b in batches:
            if b.num_rows:
                at = np.clip(((_unpack(b.column(0)) @ start / span + 1) / 2 * bins).astype(int), 0, bins - 1)
                t = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
                n[0] += np.bincount(at, minlength=bins)
                n[1] += np.bincount(at[t], minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins)), pa.array(n[0]), pa.array(n[1])], names=["at", "u", "p"])

    counts = np.zeros((2, bins))
    for r in rows.select("bits", "trusted").mapInArrow(binned, "at long, u long, p long").groupBy("at").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p")
    ).collect():
        counts[:, r["at"]] = r["u"], r["p"]
    weights = fit(stats, class_prior(counts[1], counts[0]))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _probability(_unpack(b.column(2)) @ weights)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"]
                )

    return rows.select("id", "held_out", "bits").mapInArrow(
        score, f"id {kind}, held_out boolean, score double, predicted int"
    ).withColumnRenamed("id", id_col)
