import math
import re

from quirelake.llm import private

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15
            }[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], [k for k, _ in PATTERNS].index(s[1])))


def test_base_spans_against_brute_force(docs, fixture_rows):
    got = sorted((str(r["doc_id"]), [(s["s"], s["kind"], s["e"]) for s in r["spans"] if s["base"]]) for r in private.find_private(docs).collect())
    assert got == sorted((str(d), base(t or "")) for d, t, *_ in fixture_rows)


def test_secret_is_added_and_base_stays(docs, fixture_rows):
    by = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in private.find_private(docs).collect()}
    i = next(d for d, t, *_ in fixture_rows if t and "token" in t)
    assert by[i].count("email") == 2 and "secret" in by[i]


def test_secrets_after_equals_and_long_ones_are_candidates(spark):
    short, long = "1eb9c654e721b4f812088970e66a6345cee33dd6", "aB3" * 100
    rows = [(1, f"api_key={short}"), (2, f"key {long} end"), (3, f"token={long}=="), (4, "x" * 19), (5, f"a_name_of_more_than_twenty={short}")]
    got = {r["doc_id"]: r["n_candidates"] for r in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {
        r["id"]: [
            (c["s"], c["e"]) for c in r["spans"] if c["kind"] == private.KINDS.index("secret")
        ] for r in private.candidates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    }
    assert found == {1: [(8, 48)], 2: [(4, 304)], 3: [(6, 308)], 4: [], 5: [(27, 67)]} and all(got[i] for i in (1, 2, 3, 5))


def test_gazetteers_and_context_propose(spark):
    rows = [
        (1, 'the password = "ab12cd" here'),
        (2, "call Dr. Jane Roe or Mme Dupont now"),
        (3, "hello, my name is Élodie Blanc."),
        (4, "at 12 Long Acre Street, Hauptstraße 7 and rue de la Paix, 4"),
        (5, "IBAN DE89 3704 0044 0532 0130 00 and 123-45-6789"),
        (6, "a plain text about nothing, 12 of them, said Tom"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {
        r["id"]: [
            (private.KINDS[c["kind"]], dict(rows)[r["id"]][c["s"] : c["e"]]) for c in r["spans"] if c["kind"] > 3
        ] for r in private.candidates(docs, "doc_id", "text").collect()
    }
    assert got[1] == [("secret", "ab12cd")]
    assert got[2] == [("person", "Dr. Jane Roe"), ("person", "Mme Dupont")] and got[3] == [("person", "Élodie Blanc")]
    assert got[4] == [("address", "12 Long Acre Street"), ("address", "Hauptstraße 7"), ("address", "rue de la Paix, 4")]
    assert got[5] == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "123-45-6789")] and got[6] == []


def test_empty_and_clashing(no_docs, clashing, docs):
    assert private.find_private(no_docs).count() == 0
    assert private.find_private(clashing).count() == docs.count()


def test_expectation_maximisation_separates():
    truth, rates = private.reliabilities([(0, (1, 1, 1), 80), (0, (1, 1, 0), 20), (0, (-1, -1, 1), 60), (0, (-1, 0, -1), 40)])
    assert truth[0, (1, 1, 1)] > 0.9 and truth[0, (-1, 0, -1)] < 0.1
    assert all(math.isclose(sum(side), 1) for labeler in rates[0] for side in labeler)


def test_proposals_against_all_own_spans(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(5), []
    for _ in range(300):
        own, at = [], 0
        for _ in range(rng.randrange(0, 40)):
            at += rng.randrange(0, 9)
            own.append((at, "x" * rng.randrange(1, 6), ""))
            at += len(own[-1][1])
        rows.append((own, (rng.randrange(0, at + 9), "y" * rng.randrange(1, 12), "")))
    span = "struct<s:int,m:string,b:string>"
    docs = spark.createDataFrame(rows, f"own array<{span}>, x {span}")
    for r in docs.select("own", "x", private._apart(F.col("own"), F.col("x")).alias("apart")).collect():
        lo, hi = r["x"]["s"], r["x"]["s"] + len(r["x"]["m"])
        assert r["apart"] == all(y["s"] + len(y["m"]) <= lo or hi <= y["s"] for y in r["own"])


def test_many_secrets_in_one_text(spark):
    letters = str.maketrans("0123456789", "abcDEFghXY")
    text = "".join("token=" + f"{i:024d}".translate(letters) + "\n" for i in range(16_000))
    got = private.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_candidates"] == 16_000
