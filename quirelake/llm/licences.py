"""Licence scan by a generalised suffix automaton of notices.

The words of all notices and of the phrases that name a licence make one automaton. A text is streamed through it word by word, which gives at
each word the longest run of words ending there that stands in some notice. Runs that the next word doesn't lengthen are the matches; long ones
are chained, in order both in the text and in the notice, and a chain that covers enough of its notice is a span. A phrase stands wherever its
state is on the suffix links of the state reached.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import NOTICES, PHRASES
from .words import ALNUM, alnum_words, portions, row_texts

#: Words of a match that is chained; words of the text between two matches of a chain; share of a notice that a span covers.
LEAST_MATCH, GAP, LEAST_SHARE = 4, 12, 0.6
#: What a named phrase alone counts for in the score.
NAMED = 0.5
#: Words of all notices together: an automaton of these takes some 100 MB.
MOST_WORDS = 200_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


class Automaton:
    """Generalised suffix automaton of runs of words. ``runs`` are all of its words, and ``starts`` where each run begins."""

    def __init__(self, runs: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.starts, ends = [], []  # ends: the state of each place of each run
        for words in runs:
            self.starts.append(len(ends))
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append(last)
        if len(ends) > MOST_WORDS:
            raise ValueError(f"notices of {len(ends)} words; one automaton takes {MOST_WORDS}")
        self.places: list[list[int]] = [[] for _ in self.to]  # where a state's words end, of states that long matches reach
        for at, state in enumerate(ends):
            while state > 0 and self.length[state] >= LEAST_MATCH:
                self.places[state].append(at)
                state = self.link[state]
        self.ends = ends

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.to) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that ``word`` leads to from p, of exactly one word more than p."""
        q = self.to[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.to[q]))
        self.link[q] = clone
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.to[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.to[p]:
            self.to[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest run of some notice that ends at each of ``words``; all of them are known words."""
        to, link, size, state, length = self.to, self.link, self.length, 0, 0
        for at, w in enumerate(words):
            while (after := to[state].get(w)) is None:
                state = link[state]
                length = size[state]
            state, length = after, length + 1
            yield at, state, length


@dataclass
class Found:
    """What one text holds: places of phrases as (start, phrase), and matches as (last word, length, state)."""

    n_words: int = 0
    phrases: list[tuple[int, int]] = field(default_factory=list)
    matches: list[tuple[int, int, int]] = field(default_factory=list)


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.labels, self.phrase_labels = [x for x, _ in notices], [x for _, x in phrases]
        runs = [alnum_words(t.encode()) for _, t in notices]
        named = [alnum_words(p.encode()) for p, _ in phrases]
        self.automaton = a = Automaton(runs + named)
        self.sizes = [len(r) for r in runs]
        self.notice_of = np.repeat(np.arange(len(runs) + len(named)), [len(r) for r in runs + named]).tolist()
        # phrases that end where a state ends: its own, and those of the states on its suffix links
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(named):
            if words:
                own.setdefault(a.ends[a.starts[len(runs) + k] + len(words) - 1], []).append((k, len(words)))
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in a.to]
        for state in sorted(range(1, len(a.to)), key=a.length.__getitem__):
            self.phrases_at[state] = self.phrases_at[a.link[state]] + own.get(state, [])

    def scan(self, texts: Iterator[bytes]) -> Iterator[Found]:
        known, a = self.automaton.vocabulary.get, self.automaton
        for text in texts:
            numbers = [np.fromiter(map(known, words, repeat(-1)), np.int32, len(words)) for words in map(alnum_words, pieces(text))]
            w = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            out = Found(len(w))
            # a word that no notice has ends every run, so only stretches of two known words or more are streamed
            turns = np.flatnonzero(np.diff(np.concatenate([[0], (w >= 0).astype(np.int8), [0]])))
            for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                before = (0, 0, 0)
                for at, state, length in a.statistics(w[lo:hi].tolist()):
                    for k, size in self.phrases_at[state]:
                        if size <= length:
                            out.phrases.append((lo + at - size + 1, k))
                    if before[1] >= LEAST_MATCH and length <= before[1]:
                        out.matches.append(before)
                    before = (lo + at, length, state)
                if before[1] >= LEAST_MATCH:
                    out.matches.append(before)
            yield out

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the notice) of chains that cover LEAST_SHARE of their notice and don't overlap.

        Of overlapping chains the one that covers more words stands, then the one whose notice comes first, then the earlier.
        """
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # by notice: (last word, place in the notice, words covered, first word)
        wanted = []
        for end, size, state in matches:
            for place in self.automaton.places[state]:
                notice = self.notice_of[place]
                if notice >= len(self.labels):
                    continue
                own, covered, first = chains.setdefault(notice, []), size, end - size + 1
                for e, p, c, f in reversed(own):  # ends come in order, so those too far back end the search
                    if e < end - size - GAP:
                        break
                    if e < end and p < place and (more := c + min(size, end - e, place - p)) > covered:
                        covered, first = more, f
                own.append((end, place, covered, first))
                if covered >= LEAST_SHARE * self.sizes[notice]:
                    wanted.append((-covered, notice, first, end + 1))
        taken, out = [], []  # taken: bounds of accepted spans, in order
        for covered, notice, first, end in sorted(wanted):
            k = bisect_left(taken, first + 1)
            if k % 2 == 0 and (k == len(taken) or taken[k] >= end):
                taken[k:k] = [first, end]
                out.append((self.labels[notice], first, end, min(1.0, -covered / self.sizes[notice])))
        return sorted(out, key=lambda s: s[1])


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces of about ``most`` bytes, cut only before a byte that is in no word."""
    at = 0
    while at < len(text):
        to = at + most
        while to < len(text) and ALNUM[text[to]] != 32:
            to += 1
        yield text[at:to]
        at = to


def licence_spans(
    docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, spans and score.

    n_base counts all places where a phrase's words stand one after the other, first_word and last_word are the first and last of their starts
    (null without any), base_labels their labels, distinct and sorted. spans are notices found: label, first word, word after the last, share
    of the notice's words covered. score is the largest share, at least NAMED where a phrase stands, else 0.

    A null or empty text has no words and no labels; a very long text is streamed whole, a piece at a time; repeated rows and null or repeated
    ids are rows like others; an empty table gives an empty result; other columns are not read. Notices of over MOST_WORDS words are refused.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(Scanner(notices, phrases))
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.value
        for b in portions(batches, 1):
            rows = []
            for found in scanner.scan(row_texts(b.column(1))):
                starts = [s for s, _ in found.phrases]
                spans = scanner.spans(found.matches)
                rows.append((
                    found.n_words, len(starts), min(starts, default=None), max(starts, default=None),
                    sorted({scanner.phrase_labels[k] for _, k in found.phrases}), [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans],
                    max([NAMED if starts else 0.0, *(s[3] for s in spans)])
                ))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.float64())
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "score"]
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "spans array<struct<label:string,start:long,end:long,share:double>>, score double"
    ).withColumnRenamed("id", id_col)
