"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest piece of the vocabulary that starts it, then the longest that continues it, and so on. The automaton is
a trie of the pieces. Where a character has no edge, a node's failure link leads to the node for what stays after its longest pieces were
taken off, and a precomputed number says how many those were; so each character is read once and no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import portions, row_texts, spaced_words

_loaded: dict[str, "CachedCounts"] = {}
#: Marks a count as that of an unknown word.
UNKNOWN = 1 << 40


class LongestMatch:
    """start: pieces that may begin a word; more: pieces that may continue one."""

    def __init__(self, start: Iterable[str], more: Iterable[str]):
        self.edges: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        whole = [False, False]  # node 0 begins a word, node 1 continues it
        for root, pieces in ((0, start), (1, more)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (node, c) not in self.edges:
                        self.edges[node, c] = len(children)
                        children[node].append((c, len(children)))
                        children.append([])
                        whole.append(False)
                    node = self.edges[node, c]
                whole[node] = node > 1
        self.fail, self.pops = [-1] * len(children), [0] * len(children)
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for c, child in children[node]:
                if whole[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    to, n = self.fail[node], self.pops[node]
                    while to >= 0 and (to, c) not in self.edges:
                        n += self.pops[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[child], self.pops[child] = self.edges[to, c], n
                todo.append(child)

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if no sequence of longest pieces covers it."""
        edges, fail, pops, node, n = self.edges, self.fail, self.pops, 0, 0
        for c in word:
            while (to := edges.get((node, c))) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return -1 if word else 0
        return n


class CachedCounts(dict):
    """Counts of words seen, up to ``most`` words of at most ``longest`` bytes; an unknown word is one token, marked UNKNOWN."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.automaton, self.most, self.longest = LongestMatch(*vocabulary(path)), most, longest

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count("▁" + word.decode())
        n = n if n >= 0 else UNKNOWN + 1
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model that begin a word (with its mark U+2581) and that continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p for p in pieces if p[0] == "▁" and "▁" not in p[1:]], [p for p in pieces if "▁" not in p]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words (between ASCII white space), n_pieces (greedy longest match) and n_unknown.

    A word that pieces don't cover counts as one unknown piece. A null text is empty and counts nothing; an empty table gives an empty
    result; ids may be null or repeat; a very long text is counted whole, and its long words each time they come; other columns are not read.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = CachedCounts(path)
        known = _loaded[path]
        for b in portions(batches, 1):
            rows = []
            for t in row_texts(b.column(1)):
                words = spaced_words(t)
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                total, unknown = int((n & (UNKNOWN - 1)).sum()), int((n >= UNKNOWN).sum())
                rows.append((len(words), total, unknown))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_words", "n_pieces", "n_unknown"]
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_pieces long, n_unknown long"
    ).withColumnRenamed("id", id_col)
