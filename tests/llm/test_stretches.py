"""Stretches of the tokenizer against whole texts, and the select structure of the token files."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quirelake.llm import tokens
from quirelake.llm.eliasfano import EliasFano

#: Letters that compose, change with case or are none in some Unicode version; marks, signs, digits and white space of many kinds.
ODD = list("abzJHTWAEsS tremlvd'''  .,!-<|>12\n\t\x1c\x00\x85\xa0" + "«»“”…—€。İ´¨ªº×÷ßéÉèçŉǅǰẞΣςσжЖ世界ก็̸ְ̧́̌⃝⃣̱̈ｆ１ⅫŐőȺɏɐ😀‍﻿")
PIECES = [
    "'s", "'re", "J̌", "a̧!", "mot».", "“hello”,", "word…!", "日本。!", "€!!", "naïve’.", "word™,", "İ!", "<|endoftext|>", "<|ENDOFTEXT|>", "don't",
    "é,", "É!", "Jְ̌"
]
REAL = [
    "« L’été », dit-elle… « c’est fini ! » Où ? À Besançon (Doubs), l'an 1999.",
    "„Größe“, sagte er, »ist nicht alles« – Straße 12, 3. Stock; ÄÖÜ!",
    "“Well,” he said—“it’s the dog’s bone…” They'd've gone; I'll go. 1,000.50",
    "他说：“你好，世界！”然后走了。（完）2024年",
]


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_random_texts(encode):
    rng = np.random.default_rng(2)
    made = ["".join(str(rng.choice(PIECES)) if rng.random() < 0.1 else str(rng.choice(ODD)) for _ in range(n)) for n in rng.integers(0, 14, 20_000)]
    tok = tokens.StretchTokenizer(tokens.default_path(), most=2000)
    assert tok.by_stretch
    for t, got in zip(made, tok.many(pa.array(made)), strict=True):
        assert got.tolist() == encode(t), t
    long = " ".join(made[:2000])
    want = [encode(x) for x in (long, "", long.replace("<|", ""))]
    assert [x.tolist() for x in tok.many([long.encode(), b"", long.replace("<|", "").encode()], group=500)] == want


def test_real_sentences(encode):
    tok = tokens.StretchTokenizer(tokens.default_path())
    for t in REAL:
        assert tok.ids(t.encode()).tolist() == encode(t)


def test_slices_and_nulls(encode):
    column = pa.array(["cut off", None, "It's é, 1", "", "x" * 50, None]).slice(1)
    got = list(tokens.StretchTokenizer(tokens.default_path()).many(column, group=5))
    assert [x.tolist() for x in got] == [encode(t or "") for t in column.to_pylist()]


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, other = tokens.StretchTokenizer(path), Tokenizer.from_file(path)
    text = "It's  a test, isn't it?\n\n  Yes — “so” 12"
    assert not tok.by_stretch and tok.ids(text.encode()).tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "values",
    [
        [], [0], [5, 5, 5, 9], list(range(3000)), sorted(np.random.default_rng(0).integers(0, 10**12, 3000).tolist()), [0] * 1500 + [1],
        [0, 10**9, 10**9 + 1]
    ]
)
def test_selects(values):
    e = EliasFano.of(np.array(values, np.int64))
    assert e.select_many(np.arange(len(values))).tolist() == values and e.select_many(np.arange(len(values))[::-7]).tolist() == values[::-7]
