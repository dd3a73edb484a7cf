import random
import time

from quirelake.operators import dictation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(lines, known):
    """The least sum of distances over all ways to cut ``known`` into one stretch a line."""
    best = {0: 0}
    for k, words in enumerate(lines):
        best = {
            e: min(c + distance(words, known[s:e]) for s, c in best.items() if s <= e) for e in (range(len(known) + 1) if k + 1 < len(lines) else [len(known)])
        }
    return best[len(known)]


def test_alignment_against_all_cuts():
    rng = random.Random(3)
    for _ in range(150):
        known = [rng.choice("abcdef") for _ in range(rng.randrange(0, 14))]
        read = [w if rng.random() < 0.8 else rng.choice("abcxyz") for w in known if rng.random() < 0.9]
        marks = sorted(rng.randrange(len(read) + 1) for _ in range(rng.randrange(0, 4)))
        lines = [read[a:b] for a, b in zip([0, *marks], [*marks, len(read)], strict=True)]
        got = dictation.aligned([" ".join(x) for x in lines], " ".join(known))
        assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]] and got[0][0] == 0 and got[-1][1] == len(known)
        assert all(d == distance(x, known[lo:hi]) for x, (lo, hi, d) in zip(lines, got, strict=True))
        assert sum(g[2] for g in got) == brute(lines, known)


def test_long_text_and_odd_rows(spark):
    rng = random.Random(4)
    known = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    read = [w if rng.random() < 0.9 else "?" + w for w in known if rng.random() < 0.97]
    lines = [" ".join(read[i : i + 9]) for i in range(0, len(read), 9)]
    rows = spark.createDataFrame(
        [(1, lines, " ".join(known)), (2, ["Ein Satz,", None, "der hier steht"], "ein satz der dort steht"), (3, None, "x"), (4, [], None), (5, ["a"], None)],
        "id long, lines array<string>, text string"
    )
    began = time.monotonic()
    got = {r["id"]: r["spans"] for r in dictation.align_lines(rows).collect()}
    assert time.monotonic() - began < 90
    assert sum(s["distance"] for s in got[1]) <= len(known) - len(read) + sum(w.startswith("?") for w in read)
    assert [(s["start"], s["end"], s["distance"]) for s in got[2]] == [(0, 2, 0), (2, 2, 0), (2, 5, 1)]
    assert got[3] is None and got[4] == [] and [tuple(s) for s in got[5]] == [(0, 0, 1)]
    targets = {(r["id"], r["line"]): r["target"] for r in dictation.line_targets(dictation.align_lines(rows), 0.35).where("id = 2").collect()}
    assert targets == {(2, 0): "ein satz", (2, 2): "der dort steht"}


def test_sentences_are_the_same_for_any_partitioning(spark):
    words = spark.createDataFrame([(f"word{k % 300}",) for k in range(2000)] + [(None,), ("x",), (" padded ",)], "word string")
    once = sorted(map(tuple, dictation.sentences(words, 400).collect()))
    assert once == sorted(map(tuple, dictation.sentences(words.repartition(7), 400).collect()))
    assert len({t for _, t in once}) == len(once) > 390
    for _, t in once:
        own = t.rstrip(dictation.SIGNS).split(" ")
        assert dictation.LEAST <= len(own) <= dictation.MOST and all(w.startswith("word") or w == "padded" for w in own)
    assert dictation.sentences(words.limit(0), 10).count() == 0


def test_blocks_cut_or_whole_give_the_same_places(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        known = [rng.choice("abc") for _ in range(rng.randrange(0, 25))]
        read = [w if rng.random() < 0.7 else rng.choice("abx") for w in known if rng.random() < 0.9]
        lines = [" ".join(read[i : i + 3]) for i in range(0, len(read), 3)]
        got = []
        for cells in (1 << 27, 50, 0):
            monkeypatch.setattr(dictation, "CELLS", cells)
            got.append(dictation.aligned(lines, " ".join(known)))
        assert got[0] == got[1] == got[2]


def test_a_text_of_50_000_words_is_aligned_in_seconds():
    rng = random.Random(6)
    known = [f"w{rng.randrange(3000)}" for _ in range(50_000)]
    read = [w if rng.random() < 0.9 else "?" + w for w in known if rng.random() < 0.97]
    began = time.monotonic()
    got = dictation.aligned([" ".join(read[i : i + 9]) for i in range(0, len(read), 9)], " ".join(known))
    assert time.monotonic() - began < 20 and got[-1][1] == len(known)
