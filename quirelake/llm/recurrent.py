"""Language-model scoring by a gated recurrent network with a class-factored output.

A word's class is its own if it is among the most frequent, else one of a fixed number by its last two bytes; p(word | history) =
p(class | history) * p(word | class, history). Both factors are softmaxes of the state of a GRU of few units in numpy: the first over
classes, the second over the class's members, which are the next most frequent words with those endings, and one symbol for its rest; among
the rest, counts over all training text give each word's share. Singles, members and rests have input vectors of their own. The network is
trained by backpropagation truncated at short windows: first on a small set of documents, then from there on all training documents, in slices
of bounded size, and the slices' weights are averaged by tokens. A row's slice and place come from a hash of the row, and sums run in the
slices' order, so the same rows give the same weights however the table is cut. In scoring, the state is carried through the whole document.

Word counts never come to the driver, but for the most frequent words, of which a fixed number at most is kept: the rest are joined to the
documents' words by the batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .words import numbered_words, portions, raw


@dataclass(frozen=True)
class Settings:
    """single: words with classes of their own; grouped: classes of all other words; one more class is the end; members: words in the grouped classes' softmaxes.

    frequent: words, at most, whose counts go to every task. start_docs, start_bytes: documents and bytes, about, of the first training, the
    lesser of both; start_epochs: passes over them. slice_bytes: text, about, of a slice, more where there were over most_slices of them.
    repeats: equal rows (same id and text), beyond which they are dealt to slices one by one; at least a thousandth of all.
    streams, window: texts that training runs in parallel (fewer where there is little text), and steps of truncated backpropagation.
    """

    units: int = 16
    single: int = 40
    grouped: int = 23
    members: int = 700
    frequent: int = 50_000
    start_docs: int = 1500
    start_bytes: int = 32_000_000
    start_epochs: int = 3
    slice_bytes: int = 32_000_000
    most_slices: int = 20_000
    repeats: int = 1000
    streams: int = 512
    window: int = 16
    start_rate: float = 0.01
    rate: float = 0.002
    seed: int = 7

    @property
    def classes(self) -> int:
        return self.single + self.grouped + 1

    @property
    def end(self) -> int:
        return self.single + self.grouped


def _ending(word: bytes, s: Settings) -> int:
    return zlib.crc32(word[-2:]) % s.grouped


@cache
def _endings(grouped: int) -> np.ndarray:
    """Classes of all endings of one byte, then of two."""
    return np.array(
        [zlib.crc32(bytes([a])) % grouped for a in range(256)] + [zlib.crc32(bytes([a, b])) % grouped for a in range(256) for b in range(256)]
    )


class Vocabulary:
    """Frequent words with their counts, and the symbol of any word.

    Symbols are the singles, then class by class its members and its rest, then the end. ``first``: where each grouped class's rows of the
    inner softmaxes begin; row r is of symbol single + r.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], s: Settings):
        self.s, self.words, self.counts = s, pa.array([w for w, _ in frequent], pa.binary()), np.array([n for _, n in frequent], np.int64)
        groups: list[list[bytes]] = [[] for _ in range(s.grouped)]
        for w, _ in frequent[s.single : s.single + s.members]:
            groups[_ending(w, s)].append(w)
        sizes = np.array([len(g) + 1 for g in groups])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.rest = s.single + self.first[1:] - 1
        self.end = s.single + int(self.first[-1])
        self.classes = np.concatenate([np.arange(s.single), np.repeat(s.single + np.arange(s.grouped), sizes), [s.end]])
        self.symbols = {w: i for i, (w, _) in enumerate(frequent[: s.single])}
        for g, at in zip(groups, self.first.tolist(), strict=False):
            self.symbols |= {w: s.single + at + k for k, w in enumerate(g)}
        self.symbol_words, self.symbol_numbers = pa.array(list(self.symbols), pa.binary()), np.array(list(self.symbols.values()), np.int64)

    def symbols_of(self, words: pa.Array) -> np.ndarray:
        bounds, data = raw(words)
        if not len(words):
            return np.zeros(0, np.int64)
        last, before = data[bounds[1:] - 1].astype(np.int64), data[np.maximum(bounds[1:] - 2, 0)].astype(np.int64)
        out = self.rest[_endings(self.s.grouped)[np.where(np.diff(bounds) > 1, 256 + before * 256 + last, last)]]
        return self._looked_up(words, self.symbol_words, self.symbol_numbers, out)

    def counts_of(self, words: pa.Array) -> np.ndarray:
        """Counts of frequent words, -1 of others."""
        return self._looked_up(words, self.words, self.counts, np.full(len(words), -1, np.int64))

    @staticmethod
    def _looked_up(words: pa.Array, known: pa.Array, values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        return np.where(at >= 0, values[at], otherwise) if len(known) else otherwise


def initial(s: Settings, v: Vocabulary | None = None) -> dict[str, np.ndarray]:
    """First weights; without a vocabulary, of a network over classes alone."""
    rng, h, c = np.random.default_rng(s.seed), s.units, s.classes
    shapes = {"x": (c if v is None else len(v.classes), 3 * h), "u": (h, 2 * h), "n": (h, h), "o": (h, c), "b": (c,)}
    if v is not None:
        shapes |= {"w": (int(v.first[-1]), h), "wb": (int(v.first[-1]),)}
    return {k: (rng.standard_normal(d) * (0.3 if k == "x" else 0 if k in ("b", "wb") else 0.2)).astype(np.float32) for k, d in shapes.items()}


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, s: Settings, v: Vocabulary | None = None) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, one in initial(s, v).items():
        out[k] = flat[at : at + one.size].reshape(one.shape).astype(np.float32)
        at += one.size
    return out


def _by_class(want: np.ndarray, s: Settings, v: Vocabulary) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """For each grouped class with members: where its symbols are wanted, its rows, and which of them is wanted."""
    at = np.flatnonzero((want >= s.single) & (want < v.end))
    row = want[at] - s.single
    order = np.argsort(v.classes[want[at]].astype(np.int16), kind="stable")
    at, row = at[order], row[order]
    edges = np.searchsorted(v.classes[want[at]], s.single + np.arange(s.grouped + 1))
    for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        a, b = int(v.first[k]), int(v.first[k + 1])
        if lo < hi and b - a > 1:  # the rest alone is certain
            yield at[lo:hi], slice(a, b), row[lo:hi] - a


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state and the gates, from input rows already gathered."""
    k = h.shape[1]
    g = _sigmoid(x[:, : 2 * k] + h @ p["u"])
    z, r = g[:, :k], g[:, k:]
    q = h @ p["n"]
    n = np.tanh(x[:, 2 * k :] + r * q)
    return n + z * (h - n), g, q, n


def _exponentials(states: np.ndarray, out: np.ndarray, bias: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a softmax: the exponentials, their sums, and the logits that are wanted."""
    e = states @ out
    e += bias
    np.clip(e, -30, 30, out=e)
    own = e[np.arange(len(e)), want]
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], e.dtype), own


class Trainer:
    """Adam on truncated windows over parallel streams of documents, each ended by the end class, before which the state is zero."""

    def __init__(self, p: dict[str, np.ndarray], s: Settings, rate: float, v: Vocabulary | None = None):
        self.p, self.s, self.vocabulary, self.rate, self.t, self.tokens = p, s, v, rate, 0, 0
        self.end = s.end if v is None else v.end
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def learn(self, ids: np.ndarray) -> None:
        """ids: symbols (classes, without a vocabulary) of whole documents, one after the other. They are dealt to the streams in equal parts."""
        s = self.s
        n = len(ids)
        if not n:
            return
        streams = max(1, min(s.streams, n // (64 * s.window)))
        length = -(-n // streams)
        grid = np.full(streams * length, -1, np.int64)
        grid[:n] = ids
        grid = grid.reshape(streams, length).T
        before = np.concatenate([np.full((1, streams), self.end), grid[:-1]])
        h = np.zeros((streams, s.units), np.float32)
        for at in range(0, length, s.window):
            h = self._window(before[at : at + s.window], grid[at : at + s.window], h)
        self.tokens += n

    def _window(self, given: np.ndarray, want: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, s, steps, k = self.p, self.s, len(given), self.s.units
        x = p["x"][given]
        kept, states = [], []
        for t in range(steps):
            h = h * (given[t] != self.end)[:, None].astype(np.float32)
            new, g, q, n = _step(p, x[t], h)
            kept.append((h, g, q, n))
            states.append(new)
            h = new
        flat = np.concatenate(states)
        want = want.ravel()
        y, ok = want if self.vocabulary is None else self.vocabulary.classes[want], want >= 0
        count = max(1, int(ok.sum()))
        scale = (ok / count).astype(flat.dtype)
        e, total, _ = _exponentials(flat, p["o"], p["b"], y)
        e *= (scale / total)[:, None]
        e[np.arange(len(y)), y] -= scale
        grad = {"o": flat.T @ e, "b": e.sum(0)}
        back = e @ p["o"].T
        if self.vocabulary is not None:
            grad |= {"w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
            for at, rows, which in _by_class(want, s, self.vocabulary):
                states_, w = flat[at], p["w"][rows]
                e, total, _ = _exponentials(states_, w.T, p["wb"][rows], which)
                e *= (1 / (count * total))[:, None]
                e[np.arange(len(at)), which] -= 1 / count
                grad["w"][rows], grad["wb"][rows] = e.T @ states_, e.sum(0)
                back[at] += e @ w
        back = back.reshape(steps, -1, k)
        dx = np.empty_like(x)
        du, dn = np.zeros_like(p["u"]), np.zeros_like(p["n"])
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh = dh + back[t]
            h0, g, q, n = kept[t]
            z, r = g[:, :k], g[:, k:]
            da = dh * (1 - z) * (1 - n * n)
            dx[t, :, 2 * k :] = da
            dq = da * r
            gates = np.concatenate([dh * (h0 - n), da * q], 1) * g * (1 - g)
            dx[t, :, : 2 * k] = gates
            du += h0.T @ gates
            dn += h0.T @ dq
            dh = (dh * z + gates @ p["u"].T + dq @ p["n"].T) * (given[t] != self.end)[:, None].astype(np.float32)
        order = np.argsort(given.ravel().astype(np.int16 if len(p["x"]) < 1 << 15 else np.int64), kind="stable")
        sorted_ = given.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        grad |= {"u": du, "n": dn, "x": np.zeros_like(p["x"])}
        grad["x"][sorted_[first]] = np.add.reduceat(dx.reshape(given.size, -1)[order], first, axis=0)
        self.t += 1
        for name, g in grad.items():
            m, v = self.m[name], self.v[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[name] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)
        return h


def log_class_probabilities(p: dict[str, np.ndarray], docs: list[np.ndarray], s: Settings, run: int = 16, v: Vocabulary | None = None) -> np.ndarray:
    """Natural log of the probability of each document's symbols (classes, without a vocabulary), end included.

    The state starts at zero and runs through the whole document.
    """
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    order = [i for i in order if len(docs[i])]
    if not order:
        return out
    sizes = np.array([len(docs[i]) for i in order])
    flat = np.concatenate([docs[i] for i in order])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.zeros((len(order), s.units), np.float32)
    got = np.zeros(len(order))
    at, longest = 0, int(sizes[0])
    while at < longest:
        states, wants, rows = [], [], []
        for t in range(at, min(at + run, longest)):
            n = int(np.searchsorted(-sizes, -t, "left"))  # documents of more than t tokens
            given = flat[first[:n] + t - 1] if t else np.full(n, s.end if v is None else v.end)
            h = h[:n]
            h = _step(p, p["x"][given], h)[0]
            states.append(h)
            wants.append(flat[first[:n] + t])
            rows.append(n)
        x, want = np.concatenate(states), np.concatenate(wants)
        y = want if v is None else v.classes[want]
        _, total, one = _exponentials(x, p["o"], p["b"], y)
        one -= np.log(total)
        for place, rows_, which in _by_class(want, s, v) if v is not None else ():
            _, total, own = _exponentials(x[place], p["w"][rows_].T, p["wb"][rows_], which)
            one[place] += own - np.log(total)
        got += np.bincount(np.concatenate([np.arange(n) for n in rows]), one, minlength=len(order))
        at += run
    out[order] = got
    return out


def _ended(symbols: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Symbols of the rows' words with the end after each row."""
    return np.insert(symbols, np.cumsum(sizes), end)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def word_counts(texts_: DataFrame) -> DataFrame:
    """(word, n) over all lower-cased words of the column text; each portion of text is counted before it is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0, 32_000_000):
            ids, words, _ = numbered_words(b.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(ids, minlength=len(words)))], names=["word", "n"])

    return texts_.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int, steps: int = 16) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, by falling count: all from some count on, which is found from a histogram of counts' logs."""
    level = F.floor(F.log2("n") * steps).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += r["k"]
        if held > most:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


#: Slices whose weights are added in one group.
_FAN = 16


def row_counts(docs: DataFrame) -> DataFrame:
    """(h, n, bytes) of ``docs`` (id, text): each row's hash, how many rows have it, and their text's bytes."""
    return docs.select(F.xxhash64("id", "text").alias("h"), F.octet_length("text").alias("b")).groupBy("h").agg(
        F.count("*").alias("n"), F.sum("b").alias("bytes")
    )


def _one_by_one(counts: DataFrame, block: int = 10_000) -> DataFrame:
    """(h, k) for k from 0 to n - 1 of each row of ``counts``, by blocks, so that no array is longer than one."""
    blocks = counts.select("h", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("at"))
    return blocks.select("h", F.explode(F.sequence(F.col("at") * block, F.least("n", (F.col("at") + 1) * block) - 1)).alias("k"))


def _one_of_each(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, text): one row of ``docs`` for each hash of ``hashes``, which is small."""
    hashed = docs.select(F.xxhash64("id", "text").alias("h"), "text").join(F.broadcast(hashes.select("h")), "h")
    return hashed.groupBy("h").agg(F.first("text").alias("text"))


def start_texts(docs: DataFrame, s: Settings, n_docs: int, n_bytes: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """(h, k, text) of about ``start_docs`` rows of ``docs`` (id, text), each drawn by itself, also among equal rows, whose k tells them apart.

    Which rows are drawn depends on the rows alone.
    """
    share = min(1.0, s.start_docs / max(1, n_docs), s.start_bytes / max(1, n_bytes))
    drawn = _one_by_one(row_counts(docs) if counts is None else counts).where(F.pmod(F.xxhash64("h", "k"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    return F.broadcast(drawn).join(_one_of_each(docs, drawn.select("h").distinct()), "h").select("h", "k", "text")


def sliced(docs: DataFrame, counts: DataFrame, s: Settings, n_docs: int, n_slices: int) -> DataFrame:
    """(slice, h, k, text): the rows of ``docs`` (id, text) with the slice of each, by its hash; rows that repeat very often are dealt one by one."""
    often = counts.where(F.col("n") > max(s.repeats, n_docs // 1000))  # fewer than a thousand
    hashed = docs.select(F.xxhash64("id", "text").alias("h"), F.lit(0).cast("long").alias("k"), "text")
    if often.count():
        each = _one_by_one(often).join(_one_of_each(docs, often), "h").select("h", "k", "text")
        hashed = hashed.join(F.broadcast(often.select("h")), "h", "left_anti").union(each)
    return hashed.select(F.pmod(F.xxhash64("h", "k"), F.lit(n_slices)).cast("int").alias("slice"), "h", "k", "text")


def _slice_portions(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(slice, texts) of at most ``most`` bytes, or one text, from rows (slice, text) in order of slice; Spark's batches don't show."""
    held, size, now = [], 0, -1
    for b in batches:
        number, (bounds, _) = np.asarray(b.column(0)), raw(b.column(1))
        at = 0
        while at < len(number):
            to = min(int(np.searchsorted(number, number[at], "right")), int(np.searchsorted(bounds, bounds[at] + most - size, "right")) - 1)
            if held and (number[at] != now or to <= at):
                yield now, pa.concat_arrays(held)
                held, size = [], 0
                continue
            now, to = int(number[at]), max(to, at + 1)
            held.append(b.column(1).slice(at, to - at))
            size += int(bounds[to] - bounds[at])
            at = to
    if held:
        yield now, pa.concat_arrays(held)


def train(docs: DataFrame, v: Vocabulary, s: Settings, symbol_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights from the rows of ``docs`` (id, text): a first training on about ``start_docs`` of them, then one on all, averaged over slices.

    The outputs' biases start at the logs of the classes' and members' shares, so an untrained network already scores as counts do.
    """
    sc, kind = docs.sparkSession.sparkContext, "slice long, tokens long, w binary"
    held = sc.broadcast(v)
    counts = cut(row_counts(docs), "row-counts")
    n_docs, n_bytes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    def trainer_run(start: np.ndarray, rate: float, epochs: int):
        sent = sc.broadcast(start)

        def weights(number: int, t: Trainer) -> pa.RecordBatch:
            w = _flat(t.p).astype(np.float64) * t.tokens
            columns = [pa.array([number], pa.int64()), pa.array([t.tokens], pa.int64()), pa.array([w.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "tokens", "w"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, now, t = held.value, -1, None
            for number, texts in _slice_portions(batches):
                if number != now:
                    if t is not None:
                        yield weights(now, t)
                    now, t = number, Trainer(_shaped(sent.value, s, v), s, rate, v)
                ids, words, sizes = numbered_words(texts)
                flat = _ended(v.symbols_of(words)[ids], sizes, v.end)
                for _ in range(epochs):
                    t.learn(flat)
            if t is not None:
                yield weights(now, t)

        return run

    def add(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("slice").to_pylist(), t.column("tokens").to_pylist(), t.column("w").to_pylist(), strict=True))
        total = sum(np.frombuffer(w) for _, _, w in rows)
        return pa.table({"slice": pa.array([key[0]], pa.int64()), "tokens": [sum(n for _, n, _ in rows)], "w": pa.array([total.tobytes()], pa.binary())})

    def averaged(rows: DataFrame, slices: int, otherwise: np.ndarray, *how) -> np.ndarray:
        rows = rows.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "h", "k").select("slice", "text")
        weights = rows.mapInArrow(trainer_run(otherwise, *how), kind)
        while slices > _FAN:
            weights, slices = weights.groupBy(F.expr(f"slice div {_FAN}").alias("group")).applyInArrow(add, kind), -(-slices // _FAN)
        got = sorted(weights.collect())
        return (sum(np.frombuffer(r["w"]) for r in got) / sum(r["tokens"] for r in got)).astype(np.float32) if got else otherwise

    first = initial(s, v)
    classes = np.bincount(v.classes, symbol_counts + 0.5, s.classes)
    first["b"] = np.log(classes / classes.sum()).astype(np.float32)
    first["wb"] = np.log((symbol_counts + 0.5) / classes[v.classes])[s.single : v.end].astype(np.float32)
    first["w"] *= 0.1
    start = start_texts(docs, s, n_docs, n_bytes, counts).select(F.lit(0).alias("slice"), "h", "k", "text")
    w = averaged(start, 1, _flat(first), s.start_rate, s.start_epochs)
    n_slices = max(1, min(s.most_slices, -(-n_bytes // s.slice_bytes)))
    return _shaped(averaged(sliced(docs, counts, s, n_docs, n_slices), n_slices, w, s.rate, 1), s, v)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score and score (base-10 logs).

    Training text is that of rows whose crc32(id) is outside the held fold. A null text is empty and has the end token alone; a null id is
    in no held fold; ids may repeat; with no training text all counts are zero and the network keeps its first weights; an empty table gives
    an empty result; a very long text is scored whole; other columns are not read. A word without training count has its class's share for
    one unseen word.
    """
    s, spark = settings, docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    training = plain.where(~held)
    counts = cut(word_counts(training.select("text")), "word-counts")
    n_train = training.select("id").count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = (total["n"] or 0) + n_train, total["v"] + (n_train > 0)
    frequent = _most_frequent(counts, s.frequent)
    v = Vocabulary(frequent, s)
    known = F.col("word").isin([F.lit(bytearray(w)) for w in v.symbols]) if v.symbols else F.lit(False)
    last = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    sums = {
        r["k"]: r["t"] for r in counts.where(~known).groupBy((F.crc32(last) % s.grouped).alias("k")).agg(F.sum(F.col("n") + 0.5).alias("t")).collect()
    }
    rest_log = np.log10(np.array([0.5 + sums.get(k, 0.0) for k in range(s.grouped)]))
    symbol_counts = np.zeros(len(v.classes))
    symbol_counts[v.symbol_numbers] = v.counts_of(v.symbol_words)
    symbol_counts[v.rest] = [sums.get(k, 0.0) for k in range(s.grouped)]
    symbol_counts[v.end] = n_train
    weights = _flat(train(training.select("id", "text"), v, s, symbol_counts))
    sent = spark.sparkContext.broadcast((v, weights, rest_log))
    end_log, base_log = float(np.log10(n_train + 0.5)), float(np.log10(n_all + 0.5 * (n_types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, rest_log = sent.value
        p, part = _shaped(flat, s, v), TaskContext.get().partitionId()
        for seq, b in enumerate(portions(batches, 1, 32_000_000)):
            word, words, size = numbered_words(b.column(1))
            symbols = v.symbols_of(words)
            ended = np.split(_ended(symbols[word], size, v.end), np.cumsum(size + 1)[:-1])
            rnn = log_class_probabilities(p, ended, s, v=v) / np.log(10)
            del ended
            count = v.counts_of(words)
            shared = np.full(len(v.classes), np.nan)  # of the rests: log of their words' counts
            shared[v.rest] = rest_log
            shared = shared[symbols]
            is_rest = ~np.isnan(shared)
            own_log = np.where(is_rest, 0.0, np.log10(np.maximum(count, 0) + 0.5))  # taken off again where the symbol is the word
            off = own_log + np.where(is_rest, shared, 0.0)
            doc = np.repeat(np.arange(len(size)), size)
            n = len(size)
            here = count[word] >= 0
            logs = np.bincount(doc[here], np.log10(count[word[here]] + 0.5), n) + end_log
            seen = np.bincount(doc[here], minlength=n) + (n_train > 0)
            more = rnn - np.bincount(doc, off[word], n) - end_log
            key = f"{part}:{seq}"
            # the documents' own figures, as one value: list columns would slow each row of the grouped transfer
            own = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *map(pa.array, (size + 1, seen, logs, more))], names=["ids", "held", "tokens", "seen", "logs", "more"]
            )
            names_ = ["word", "batch", "docs", "own"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f" {key}".encode()], pa.binary()), pa.array([key]), pa.array([_packed(own)], pa.binary()), pa.array([True])], names=names_
            )
            # the other words, each with the documents it stands in
            doc, word = doc[~here], word[~here]
            order = np.argsort(word, kind="stable")
            doc, word = doc[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            width = np.uint16 if n <= 65536 else np.uint32
            ends = np.concatenate([first[1:], [len(word)]]) if len(word) else first
            for at in range(0, len(first), 100_000):
                f, e = first[at : at + 100_000], ends[at : at + 100_000]
                offsets = (np.concatenate([f, e[-1:]]) - f[0]).astype(np.int32) * np.dtype(width).itemsize
                blob = pa.Array.from_buffers(
                    pa.binary(), len(f), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(doc[f[0] : e[-1]].astype(width).tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(word[f])), pa.array([key] * len(f)), blob, pa.array([False] * len(f))], names=names_
                )

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        is_own = np.asarray(t.column("own").combine_chunks().to_numpy(zero_copy_only=False), bool)
        blobs, found = t.column("docs").to_pylist(), np.asarray(t.column("n").combine_chunks().fill_null(0)).astype(np.int64)
        at = int(np.flatnonzero(is_own)[0])
        got = pa.ipc.open_stream(blobs.pop(at)).read_all()
        found = np.delete(found, at)
        n = got.num_rows
        width = np.uint16 if n <= 65536 else np.uint32
        flat = np.frombuffer(b"".join(blobs), width)
        c = np.repeat(found, np.array([len(x) for x in blobs], np.int64) // np.dtype(width).itemsize)
        tokens, seen, logs, more = (np.asarray(got.column(x).combine_chunks()) for x in ("tokens", "seen", "logs", "more"))
        logs = logs + np.bincount(flat, np.log10(c + 0.5), n)
        seen = seen + np.bincount(flat[c > 0], minlength=n)
        return pa.table(
            {
                "id": got.column("ids"), "held_out": got.column("held"), "n_tokens": tokens, "n_known": seen, "train_tokens": np.full(n, n_all),
                "base_score": logs - tokens * base_log, "score": logs + more
            }
        )

    rows = plain.withColumn("held", held).mapInArrow(run, "word binary, batch string, docs binary, own boolean")
    joined = rows.join(counts, "word", "left").drop("word")
    return joined.groupBy("batch").applyInArrow(
        finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("id", id_col)
