import random
import re

import pytest

from quirelake.llm.licence_texts import NOTICES, PHRASES
from quirelake.llm.licences import LEAST_MATCH, NAMED, Automaton, Scanner, licence_spans, pieces
from quirelake.llm.words import alnum_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def texts():
    rng = random.Random(5)
    parts = "gnu general public license apache mit cc by , . the of software GNU License Apache-License MIT".split()
    out = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += [None, "", "CC BY-NC 4.0", "cc\nby", "ccby", "MIT LICENSE mit license", "Ünlicense mit license", "mit license " * 20_000]
    notices = [n for _, n in NOTICES]
    out += notices + ["Some words first. " + n.replace("software", "program").upper() + "\n\nand code after " * 40 for n in notices]
    return out


def test_statistics_are_the_longest_runs_that_stand_in_a_notice():
    rng = random.Random(1)
    runs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(8)]
    a = Automaton(runs)
    held = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(500)]
    for at, state, length in a.statistics([a.vocabulary[w] for w in text]):
        assert tuple(text[at + 1 - length : at + 1]) in held
        assert length > at or tuple(text[at - length : at + 1]) not in held
        if length >= LEAST_MATCH:
            flat = [w for r in runs for w in r]
            ends = [e for s, r in zip(a.starts, runs, strict=True) for e in range(s + length - 1, s + len(r)) if flat[e + 1 - length : e + 1] == text[at + 1 - length : at + 1]]
            assert sorted(a.places[state]) == ends


def test_base_places_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in licence_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
        assert 0 <= r["score"] <= 1 and r["score"] >= (NAMED if r["n_base"] else 0)


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_a_notice_is_found_whole_and_with_a_word_changed(k):
    label, notice = NOTICES[k]
    scanner = Scanner()
    words = notice.split()
    changed = words[: len(words) // 3] + ["anders"] + words[len(words) // 3 + 1 :]
    for text, share in ((notice, 1.0), (" ".join(changed), 0.6)):
        found = next(scanner.scan(iter([("eine zeile davor\n" + text + "\nund danach").encode()])))
        (got,) = scanner.spans(found.matches)
        assert got[0] == label and got[3] >= share
        assert got[1] == 3 and got[2] == found.n_words - 2


def test_repeated_notices_are_spans_of_their_own_and_plain_text_has_none():
    scanner = Scanner()
    text = ("\nfiller words here\n".join([NOTICES[0][1], NOTICES[3][1]] * 50)).encode()
    spans = scanner.spans(next(scanner.scan(iter([text]))).matches)
    assert [s[0] for s in spans] == ["mit", "apache"] * 50
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    plain = b"the software is free of charge and you can use it in any way that the law does not forbid to you " * 30
    assert scanner.spans(next(scanner.scan(iter([plain]))).matches) == []


def test_pieces_cut_no_word():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab é.\n世 ") for _ in range(rng.randint(0, 80))).encode()
        assert b"".join(pieces(text, 7)) == text
        assert [w for p in pieces(text, 7) for w in alnum_words(p)] == alnum_words(text)


def test_odd_tables(docs, no_docs, clashing, fixture_rows):
    assert licence_spans(no_docs).count() == 0
    rows = licence_spans(clashing).collect()
    assert len(rows) == len(fixture_rows)
    assert sorted(map(str, rows)) == sorted(map(str, licence_spans(docs).collect()))
