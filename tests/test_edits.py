"""Edit distances by bits against the table of distances and the built-in function."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import edits

TEXTS = st.text(st.sampled_from("ab \nяї́𝛼"), max_size=70)


def by_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(TEXTS, TEXTS, TEXTS, TEXTS)
def test_any_texts(a, b, before, after):
    want = by_table(a, b)
    assert edits.distance(a, b) == edits.distance(b, a) == want
    assert edits.distance(before + a + after, before + b + after) == by_table(before + a + after, before + b + after)


def _other(rng, text, share):
    """``text`` with a share of its characters removed, replaced or doubled."""
    out = []
    for c in text:
        out += rng.choice([[], [rng.choice("ab я")], [c, c]]) if rng.random() < share else [c]
    return "".join(out)


def test_pairs_together_against_each_alone(monkeypatch):
    rng = random.Random(4)
    for few, many, part in ((1, 256, 8), (1, 5, 2), (1, 256, 400), (12, 256, 64)):  # narrow bands, which must be widened, too
        for name, value in (("FEW", few), ("MANY", many), ("PART", part)):
            monkeypatch.setattr(edits, name, value)
        pairs = []
        for _ in range(120):
            a = "".join(rng.choices("abcd я", k=rng.choice([0, 1, 63, 64, 65, 128, rng.randrange(400)])))
            b = rng.choice([_other(rng, a, 0.1), _other(rng, a, 0.5), a[rng.randrange(len(a) + 1) :] + "b", "".join(rng.choices("cd 𝛼", k=rng.randrange(300)))])
            pairs.append(rng.choice([(a, b), (b, a)]))
        assert edits.distances(pairs) == [edits.distance(*p) for p in pairs]


def test_pages_are_compared_faster_together():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefghijklmnop .\n", k=rng.randrange(900, 1300))) for _ in range(400)]
    pairs = [(t, _other(rng, t, 0.15)) for t in texts]
    began = time.process_time()
    alone = [edits.distance(*p) for p in pairs]
    between = time.process_time()
    assert edits.distances(pairs) == alone
    assert time.process_time() - between < between - began


def test_columns(spark):
    long = "слово за словом, 𝛼𝛽 " * 40
    pairs = [
        (None, "a"), ("a", None), (None, None), ("", ""), ("", long), (long, ""), (long, long), (long, long[5:] + "ще"), (long, long[::-1]),
        ("кіт", "кит"), (long + "x" * 300, "y" * 200 + long), ("x" * 70_000, "y" * 3)
    ]
    rows = spark.createDataFrame(pairs, "a string, b string")
    one = rows.select(edits.edit_distance(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want")).collect()
    assert [r["got"] for r in one] == [r["want"] for r in one]
    many = F.array("a", F.lit("кит"), F.lit(None).cast("string"), F.concat("a", F.lit("!")))
    got = rows.where("b IS NOT NULL").select(
        edits.edit_distances(many, F.col("b")).alias("got"), F.transform(many, lambda t: F.levenshtein(t, F.col("b"))).alias("want")
    ).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    none = F.lit(None).cast("array<string>")
    assert rows.select(edits.edit_distances(none, F.col("b")).alias("n")).where("n IS NOT NULL").count() == 0


def test_a_text_of_many_thousand_characters():
    text = "".join(chr(97 + (i * i) % 23) for i in range(30_000))
    assert edits.distance(text, text[:10_000] + "!" + text[10_002:]) == 2
    assert edits.distance(text[1:] + "?", text) == 2
