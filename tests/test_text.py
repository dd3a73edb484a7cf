import random

from pyspark.sql import functions as F

from quirelake.functions import text as X

# (text, type, normalised)
VECTORS = [
    ("Доброго ранку", "handwritten", "Доброго ранку"),
    ("cocна", "handwritten", "сосна"),
    ("тире — довге", "handwritten", "тире - довге"),
    ("~~закреслено~~ слово", "handwritten", "закреслено слово"),
    ("~~старе~~{нове} слово", "printed", "нове слово"),
    ("x_{3} + y^{2}", "formula", "х_3 + у^2"),
    ("A | B | C", "table", "А|В|С"),
    ("x² + y₃", "formula", "х^2 + у_3"),
    ("«Привіт»", "handwritten", '"Привіт"'),
    ("( дужки )", "handwritten", "(дужки)"),
    ("_____", "handwritten", "___"),
    ("-----", "handwritten", "___"),
    ("π r^2", "formula", "π r^2"),
    ("2 * 3 = 6", "formula", "2 · 3 = 6"),
    ("H_{2}SO_{4}", "formula", "Н_2SО_4"),
    (r"\frac{1}{2}", "formula", "1/2"),
    (r"\frac{\frac{1}{2}}{3}", "formula", "1/2/3"),
    (r"\sqrt{169}", "formula", "√169"),
    (r"\bar{x}", "formula", "х"),
    ("(1; -1)", "formula", "1\n-1"),
    ("| 3 2 | | -1 1 |", "formula", "3 2\n-1 1"),
    (r"\overrightarrow{AB}", "formula", "→АВ"),
    (r"\vec{a}", "formula", "→а"),
    (r"\therefore \overrightarrow{AB} \perp \overrightarrow{AC}", "formula", "∴ →АВ ⊥ →АС"),
    ("x̄", "formula", "х"),
    (r"\mathrm{\mathbf{k}}", "formula", "k"),
    (r"\sin(x)", "formula", "sіn(х)"),
    (r"\begin{pmatrix}1 & 2 \\ 3 & 4\end{pmatrix}", "table", "1|2\n3|4"),
    ("", "formula", ""),
    (None, "handwritten", ""),
]


def test_normalize_vectors(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(VECTORS)], "i int, t string, k string")
    got = {r["i"]: r["n"] for r in rows.select("i", X.normalize(F.col("t"), F.col("k")).alias("n")).collect()}
    for i, (t, k, want) in enumerate(VECTORS):
        assert got[i] == want, (t, k)


def one(spark, c, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()))
    return row.select(c.alias("v")).first()["v"]


def test_targets(spark):
    t, k = F.col("t"), F.col("k")
    f = X.normalize_target(t, k)
    assert one(spark, f, t="a\n  b\tc", k="handwritten") == "a b c"
    assert one(spark, f, t="a = 1\r\n\n  b = 2 ", k="formula") == "a = 1\nb = 2"
    assert one(spark, f, t="| a | b |\n| c | d |", k="table") == "a|b\nc|d"
    assert one(spark, f, t="ﬁ~~x~~{y}", k="other") == "fiy"


def test_plausibility(spark):
    t = F.col("t")
    for text, ok in (("5", True), ("---", False), ("", False), (" а а а а ", False), ("а б в г", True), ("x%%%%%%%", False)):
        assert one(spark, X.is_confident(t), t=text) is ok, text
    for text, ok in (("a", False), ("ні", True), ("x" * 301, False), ("... a .......", False), ("а а а а", False)):
        assert one(spark, X.is_valid_label(t), t=text) is ok, text


def test_choice_flags_and_settings(spark):
    c = X.choose_text(F.col("a"), F.col("b"), F.col("p"))
    assert one(spark, c, a="---", b="слово", p=0.9) == "слово"
    assert one(spark, c, a="---", b="слово", p=0.5) == "---"
    assert one(spark, c, a="добре", b="слово", p=0.9) == "добре"
    f = X.text_flags(F.col("t"))
    assert one(spark, f, t="a" * 200) == ["long_text", "character_loop"]
    assert one(spark, f, t="так так так Так так") == ["token_loop"]
    assert one(spark, f, t="- - - - - - - -") == ["dash_loop"]
    assert one(spark, f, t=None) == []
    s = X.generation_settings(F.col("k"), {"table": 192})
    assert tuple(one(spark, s, k="table")) == (192, None)
    assert tuple(one(spark, s, k="PRINTED")) == (160, 1.05)


def test_bins(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 15, 16, 96, 97, 180, 181, 5000)], "n int")
    assert [
        r[0] for r in rows.select(X.bin_label(F.col("n"), X.LENGTH_BINS)).collect()
    ] == ["0-15", "0-15", "16-40", "41-96", "97-180", "97-180", "181+", "181+"]


def test_keys(spark):
    assert one(spark, X.compact(F.col("t")), t="Ab, c-d​!") == "abcd"
    assert one(spark, X.token_key(F.col("t")), t="«Слово»,") == "слово"
    assert one(spark, X.looks_math(F.col("t")), t="ab") is False
    assert one(spark, X.looks_math(F.col("t")), t="a+b") is True


def test_texts_that_no_pattern_touches_are_passed_over_rightly(spark):
    """The short way, for texts without any character that a pattern needs, is what all patterns leave; so for random texts of such and other characters."""
    import random

    from quirelake.functions import markup

    rng = random.Random(5)
    signs = list("ab aeO, .;|&*~~{}_-^()\"'\\\n\t1²₂√́«»“’—–− ​\x1c\x85 жI") + ["  ", "~~", "___", "\r\n"]
    texts = ["".join(rng.choice(signs[: rng.choice((6, 12, len(signs)))]) for _ in range(rng.randrange(9))) for _ in range(3000)]
    for t in texts:
        whole = markup._apply(t, markup._struck)
        for again, rules in markup._compiled:
            before, whole = whole, markup._apply(whole, rules)
            while again and whole != before:
                before, whole = whole, markup._apply(whole, rules)
        assert markup.rewrite(t) == whole
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    c = F.col("t")
    every = X.strip(X._common(X.chain(c, *X.STRUCK)))
    lines, plain = X.strip(X._table_lines(X._common(c))), X.strip(X._common(c))
    off = df.where((X.normalize_natural(c) != every) | (X.finish_markup(c, F.lit("table")) != lines) | (X.finish_markup(c, F.lit("formula")) != plain))
    assert off.collect() == []
    assert df.where(~c.rlike(X.TOUCHED)).count() > 300


def test_plain_texts_are_told_from_those_that_patterns_touch(spark):
    rng = random.Random(11)
    marks = [*map(chr, range(0x1, 0x80)), "\xa0", "​", "–", "“", "ʼ", "я", "é", "𝛼", "  "]
    texts = ["".join(rng.choices("ab C.,9 ", k=rng.randrange(6))) + rng.choice([m, "", ""]) + "".join(rng.choices("ab C.,9 ", k=rng.randrange(6))) for m in marks * 8]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " ", "a", None]], "t string")
    assert df.where(~X.touched(F.col("t")).eqNullSafe(F.col("t").rlike(X.TOUCHED))).count() == 0
    assert df.where(X.touched(F.col("t"))).count() > 300


def test_markup_of_arrays_with_and_without_marks(spark):
    from quirelake.functions import markup

    plain, marked = [["a", None, "b c"], None, [], ["√"[:0], "x" * 50]], [["a", r"\frac{1}{2}", None], None, [], ["²"], ["~~x~~", "b", r"\alpha_{i}"], ["c"]]
    for rows in (plain, marked, [None, None], [[]], [[None]]):
        df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, a array<string>").coalesce(1)
        got = {r["k"]: r["m"] for r in df.select("k", markup.rewrite_markup_array(F.col("a")).alias("m")).collect()}
        assert got == {k: r and [t and markup.rewrite(t) for t in r] if r is not None else None for k, r in enumerate(rows)}
    signs = [*map(chr, range(1, 0x250)), *map(chr, range(0x2ff, 0x371)), *map(chr, range(0x2070, 0x2100)), *markup.SYMBOLS.values(), "∗", "⋅", "я", "𝛼"]
    df = spark.createDataFrame([(c, [c, f"a{c}b"]) for c in signs], "c string, a array<string>")
    assert all(r["m"] == [markup.rewrite(t) for t in r["a"]] for r in df.select("a", markup.rewrite_markup_array(F.col("a")).alias("m")).collect())
    assert markup.rewrite_markup_array.evalType != markup.rewrite_markup.evalType  # no pandas series of arrays is made
