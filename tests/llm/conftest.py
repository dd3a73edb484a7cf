import random

import pytest

WORDS = "the of and ing tion er est that with for was this une des eau für und sch ción los".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def fixture_rows():
    """(doc_id, text, lang, source, n_chars): plain texts, copies, near copies, null, empty and long ones, repeated rows and null ids."""
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 4, 20, 60, 200])) for _ in range(60)]
    base = prose(rng, 120)
    near = base.split()
    texts += [base, base, base.upper(), " ".join(near[:60] + ["anders"] + near[60:]), " ".join(near[:-1])]
    texts += [None, "", " \n\t ", "x" * 30_000, "1 2 " * 4_000, "Ünïcödé 世界 " * 30, "a b c"]
    texts += ["line one is here\nshared line of the site\n" + prose(rng, 12) for _ in range(12)]
    texts += [
        "mail me at a.b@mail.example.com, or +1 (499) 555-6503 now 4111 1111 1111 1111 at 10.0.0.255",
        'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" x@y.z_d@e.f 999.1.1.1 1.2.3.4.5', "+1 234 +12345678901 4111-1111-1111-1112",
        "<|endoftext|> It's <|ENDOFTEXT|> don't, 'll"
    ]
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "a row without an id " * 5, None, None, None), (None, None, "en", None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


#: Columns whose names the operators use themselves.
CLASHING = (
    "id", "text_", "class", "band", "tag", "host", "line", "row", "spans", "kind", "bits", "word", "batch", "n", "size", "part", "items", "held",
    "sequence_id", "n_lines", "n_dropped"
)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("z").alias(c) for c in CLASHING])
