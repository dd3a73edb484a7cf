"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from patterns, from gazetteers (titles before names, words of streets) and from context (what follows a word for a
password, or "my name is"). Labelers vote on each candidate: patterns check its form, gazetteers its parts, and context labelers the words
beside it. Expectation-maximisation over the counts of vote patterns, of which there are boundedly many, estimates how reliable each
labeler is without any gold label. The resulting probabilities train a logistic classifier over span features, which decides on the
candidates beyond the base ones.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

KINDS = ("email", "ip", "card", "phone", "secret", "person", "address", "account")
#: Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Sra", "Mme", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
GIVEN_NAMES = (
    "Anna", "Anne", "Carlos", "Carmen", "Claire", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "José", "Juan", "Julia", "Karl", "Laura",
    "Lucas", "Maria", "María", "Marie", "Martin", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sophie", "Thomas"
)
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Boulevard", "Blvd", "Square")
STREET_ENDINGS = ("straße", "strasse", "weg", "platz", "gasse", "allee")
STREET_STARTS = ("rue", "avenue", "boulevard", "place", "calle", "plaza", "avenida")
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE", "UA")
#: What a text says before a person's name, and before a secret.
NAMED = "my name is|i am called|ich heiße|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|name:"
SECRET_CUE = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key"
#: Base patterns. Possessive quantifiers and look-behinds only spare the regex engine retries that cannot succeed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])",
    "person": r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){0,2}",
    "address": r"(?<![0-9])[0-9]{1,5} (?:\p{Lu}\p{Ll}++ ){1,2}(?:"
    + "|".join(STREETS)
    + r")(?!\p{L})|(?<!\p{L})\p{Lu}\p{Ll}*(?:"
    + "|".join(STREET_ENDINGS)
    + r") [0-9]{1,4}(?![0-9])|(?<!\p{L})(?:"
    + "|".join(STREET_STARTS)
    + r") (?:de la |de |du |des |del )?\p{Lu}\p{Ll}++,? [0-9]{1,4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Context that proposes what follows it: the pattern with the cue, and the part of a match that is the span, its last.
PROPOSED = {
    "secret": (r"(?i:" + SECRET_CUE + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?[^\s\"',;]{6,}+", r"[^\s\"',;:=]+[^\s\"',;]*$"),
    "person": (r"(?i:" + NAMED + r") \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){0,2}", r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}$"),
}


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _may_hold(text: Column, kind: str, proposed: bool = False) -> Column:
    """False for texts that cannot hold the kind: looked up by what scans fast."""
    if proposed and kind == "secret":
        return _holds(text, ("=", ":")) & _holds(F.lower(text), ("passw", "passphr", "pwd", "secret", "token", "key"))
    if proposed:
        return _holds(text, ("y name is", "am called", "ch heiße", "ein name ist", "'appelle", "on nom est", "e llamo", "i nombre es", "ame:"))
    if kind == "person":
        return _holds(text, ("Mr", "Ms", "Dr", "Prof", "Sr", "Mme", "Herr", "Frau", "Monsieur", "Madame", "Señor"))
    if kind == "address":
        words = (
            " St", " Road", " Rd", " Ave", " Lane", " Drive", " Boulevard", " Blvd", " Square", *STREET_ENDINGS, *(f"{w} " for w in STREET_STARTS)
        )
        return text.rlike("[0-9]") & _holds(text, words)
    return text.rlike(
        {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_+/-]{20}", "account": r"[0-9]{4}"}[kind]
    )


TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "us", "ca", "it", "nl", "ch", "at", "be")
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo|kontakt)[^A-Za-z0-9]{0,4}$",
    "ip": r"(?i)(?:ip|address|host|server|client|login|from)[^A-Za-z0-9]{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)(?: (?:no|number|nr))?[^A-Za-z0-9]{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)[^A-Za-z0-9]{0,4}$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|key|credential|bearer)[^A-Za-z0-9]{0,6}$",
    "person": r"(?i)(?:" + NAMED + r"|contact|signed|author|by|von|par|por)[^A-Za-z0-9]{0,4}$",
    "address": r"(?i)(?:address|lives at|located at|adresse|wohnt|anschrift|habite|dirección|domicilio)[^A-Za-z0-9]{0,4}$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta|ssn|social security)(?: (?:no|number|nr))?[^A-Za-z0-9]{0,4}$",
}
LABELERS = ("form", "gazetteer", "cue", "checks", "shape")
CONTEXT = 32
#: Matches in a block of a text.
BLOCK = 128


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _apart(own: Column, x: Column) -> Column:
    """Whether ``x`` meets none of the spans ``own``, which are in order and apart: only the last that begins before its end can reach into it.

    That one is looked for by halving, so many proposals among many spans cost little more each.
    """
    end = x["s"] + F.length(x["m"])
    bounds = F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi"))  # spans that begin before the end: lo at least, hi at most

    def halve(acc: Column, _: Column) -> Column:
        middle = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = (acc["lo"] < acc["hi"]) & (F.get(own, middle - 1)["s"] < end)
        return F.struct(F.when(before, middle).otherwise(acc["lo"]).alias("lo"), F.when(before, acc["hi"]).otherwise(F.greatest(middle - 1, acc["lo"])).alias("hi"))

    # as many steps as the list's length has binary digits
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(own).cast("long"))) + 1)
    n = F.aggregate(steps, bounds, halve, lambda acc: acc["lo"])
    return _let(n, lambda k: (k == 0) | (F.get(own, k - 1)["s"] + F.length(F.get(own, k - 1)["m"]) <= x["s"]))


def _found(text: Column, kind: str) -> Column:
    """(start, span, before) of each candidate: the matches of its pattern, and what context proposes beside them."""
    own = _matches(text, PATTERNS[kind], _may_hold(text, kind))
    if kind not in PROPOSED:
        return own
    pattern, last = PROPOSED[kind]

    def trimmed(x: Column) -> Column:
        span = F.regexp_extract(x["m"], last, 0)
        before = F.right(F.concat(x["b"], F.left(x["m"], F.length(x["m"]) - F.length(span))), F.lit(CONTEXT))
        return F.struct((x["s"] + F.length(x["m"]) - F.length(span)).alias("s"), span.alias("m"), before.alias("b"))

    more = F.transform(_matches(text, pattern, _may_hold(text, kind, True)), trimmed)

    def joined(both: Column) -> Column:
        return F.concat(both["own"], F.filter(both["more"], lambda x: (x["m"] != "") & _apart(both["own"], x)))

    return _let(F.struct(own.alias("own"), more.alias("more")), lambda both: F.when(F.size(both["more"]) > 0, joined(both)).otherwise(both["own"]))


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """(start, span, before) of each match: starts are sums of the lengths of what lies between matches, in code points.

    A list grows by copying, so it is made in blocks, whose own starts are summed after that: the work is in proportion to the matches.
    """
    empty = F.array().cast("array<struct<s:int,m:string,b:string>>")
    gaps, spans = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        one = F.struct(start.alias("s"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT)).alias("b"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def blocks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return F.transform(
            numbers, lambda i: F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
        )

    def joined(made: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        first = F.aggregate(
            made, nothing, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"]
        )
        return F.flatten(
            F.zip_with(
                made, first,
                lambda x, before: F.transform(x["out"], lambda y: F.struct((y["s"] + before).alias("s"), y["m"].alias("m"), y["b"].alias("b")))
            )
        )

    pairs = F.zip_with(spans, F.slice(gaps, F.lit(1), F.size(spans)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    got = _let(pairs, lambda p: F.when(F.size(p) > 0, _let(blocks(p), joined)).otherwise(empty))
    return F.when(may, got).otherwise(empty)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _is_base(kind: str, span: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return span.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(10, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _labels(kind: str, span: Column, before: Column, base: Column) -> list[Column]:
    """Votes 1, -1 or 0 of LABELERS, in their order."""
    digits, never = _digits(span), F.lit(False)
    letters, numbers = span.rlike("[A-Za-z]"), span.rlike("[0-9]")
    cue = _vote(before.rlike(CUES[kind]), before.rlike(r"(?i)(?:version|isbn|doi|page|line|figure|id|no)[^A-Za-z0-9]{0,3}$"))
    if kind == "email":
        top = F.lower(F.element_at(F.split(span, r"\."), -1))
        return [
            _vote(base, never), _vote(top.isin(*TOP_DOMAINS), ~top.rlike("^[a-z]{2,}$")), cue,
            _vote(span.rlike(r"^[A-Za-z0-9]"), span.rlike(r"\.@|@-")), _vote(F.length(span) <= 64, F.length(span) > 254)
        ]
    if kind == "ip":
        return [
            _vote(base, ~base), _vote(~span.rlike(r"^(?:0|127|255)\."), span.rlike(r"^0+\.")), cue,
            _vote(span.rlike(r"[0-9]{2,}\."), span.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
            _vote(base & (F.length(span) <= 15), span.rlike(r"[0-9]{4}"))
        ]
    if kind == "card":
        n = F.length(digits)
        return [
            _vote(base, ~base), _vote(digits.rlike(CARD_STARTS), digits.rlike("^0")), cue, _vote(n.between(15, 16), (n < 13) | (n > 19)),
            _vote(span.rlike(r"^[0-9]+$|^(?:[0-9]{4}[ -]){3}"), span.rlike(r"^[0-9]{1,3}[ -]"))
        ]
    if kind == "phone":
        n = F.length(digits)
        return [
            _vote(base, ~base), _vote(span.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])"), span.rlike(r"^\+0")), cue,
            _vote(n.between(11, 13), n < 8), _vote(span.rlike(r"[ ()-]"), span.rlike(r"\.[0-9]*\."))
        ]
    if kind == "person":
        words = F.split(span, " ")
        return [
            _vote(span.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), never), _vote(F.exists(words, lambda w: w.isin(*GIVEN_NAMES)), never), cue,
            _vote(F.size(words) >= 3, F.size(words) < 2), _vote(F.length(span) <= 40, span.rlike(r"(?i)(?:the|this|that)$"))
        ]
    if kind == "address":
        return [
            _vote(numbers & letters, ~numbers), _vote(span.rlike("|".join((*STREETS, *STREET_ENDINGS, *STREET_STARTS))), never), cue,
            _vote(span.rlike("(?<![0-9])[0-9]{1,3}(?![0-9])"), span.rlike("[0-9]{5}")), _vote(F.length(span).between(8, 50), F.length(span) > 80)
        ]
    if kind == "account":
        plain = F.replace(span, F.lit(" "))
        return [
            _vote(plain.rlike(r"^[A-Z]{2}[0-9]{13,32}$|^[0-9]{3}-"), ~numbers), _vote(F.left(span, F.lit(2)).isin(*ACCOUNT_COUNTRIES), letters), cue,
            _vote(F.length(digits) >= 9, F.length(digits) < 8), _vote(F.length(plain).between(11, 34), F.length(plain) > 34)
        ]
    mixed = letters & numbers
    return [
        _vote(span.rlike(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$"), ~mixed),
        _vote(span.rlike(r"^(?:sk|pk|ghp|gho|AKIA|xox[bp])[_-]?[A-Za-z0-9]"), span.rlike("/.*/")), cue, _vote(mixed & ~span.rlike("[/_-]"), ~numbers),
        _vote(F.length(span) >= 32, span.rlike("^[A-Za-z-]+$"))
    ]


def _features(kind: str, span: Column, before: Column) -> list[Column]:
    """Indicators of a span that the final classifier sees."""
    n = F.length(span)
    yes = [
        n <= 12, n <= 20, n >= 32, span.rlike("^[0-9]+$"), span.rlike("[A-Za-z]") & span.rlike("[0-9]"), span.rlike("[^A-Za-z0-9]"),
        before.rlike(CUES[kind]), before.rlike(r"[\"'=:]\s*$")
    ]
    return [x.cast("int") for x in yes]


N_FEATURES = 8
CANDIDATE = "array<struct<kind:int,s:int,e:int,base:boolean,votes:array<int>,feats:array<int>>>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and, by start, all candidate spans with their votes and features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    for kind in KINDS:
        out = out.withColumn(f"f_{kind}", _found(F.col("text"), kind))

    def told(kind: str) -> Column:
        def one(x: Column) -> Column:
            base = _is_base(kind, x["m"])
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), base.alias("base"),
                F.array(*_labels(kind, x["m"], x["b"], base)).alias("votes"), F.array(*_features(kind, x["m"], x["b"])).alias("feats")
            )

        return F.transform(f"f_{kind}", one).cast(CANDIDATE)

    return out.select("id", *[told(k).alias(f"c_{k}") for k in KINDS]).select("id", F.concat(*[f"c_{k}" for k in KINDS]).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict[tuple[int, tuple[int, ...]], float], dict]:
    """Expectation-maximisation over (kind, votes, count): the probability that a span of each pattern is personal data, and each labeler's rates.

    Labelers are taken as independent given the truth; each has, for each kind, rates of voting -1, 0 and 1 on true and on false spans.
    """
    truth, rates = {}, {}
    by_kind = defaultdict(list)
    for kind, votes, n in patterns:
        by_kind[kind].append((votes, n))
    for kind, rows in by_kind.items():
        width = len(rows[0][0])
        p = {v: 1 / (1 + math.exp(-1.2 * sum(v))) for v, _ in rows}  # the votes' majority to begin with
        for _ in range(rounds):
            prior, rate = 1.0, [[[1.0] * 3, [1.0] * 3] for _ in range(width)]
            total = 2.0
            for v, n in rows:
                prior += p[v] * n
                total += n
                for j, x in enumerate(v):
                    rate[j][1][x + 1] += p[v] * n
                    rate[j][0][x + 1] += (1 - p[v]) * n
            prior /= total
            rate = [[[c / sum(side) for c in side] for side in labeler] for labeler in rate]
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j][1][x + 1] / rate[j][0][x + 1]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        truth.update({(kind, v): p[v] for v, _ in rows})
        rates[kind] = rate
    return truth, rates


def fit(rows: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], truth: dict, steps: int = 300, rate: float = 0.5) -> dict[int, list[float]]:
    """Logistic weights (bias first) for each kind from (kind, votes, features, count), with the estimated truths as soft labels."""
    out = {}
    for kind in range(len(KINDS)):
        own = [((1, *f), truth[kind, v], n) for k, v, f, n in rows if k == kind]
        w = [0.0] * (N_FEATURES + 1)
        total = sum(n for *_, n in own) or 1
        for _ in range(steps if own else 0):
            slope = [1e-3 * x for x in w]
            for f, y, n in own:
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True)))))) - y) * n / total
                for j, x in enumerate(f):
                    if x:
                        slope[j] += e
            w = [a - 4 * rate * g for a, g in zip(w, slope, strict=True)]
        out[kind] = w
    return out


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, spans and n_candidates. A span has kind, s and e (code points, end exclusive) and base.

    Base spans always stay; other candidates stay if the classifier's probability reaches ``accept``. Spans are ordered by start, then kind.
    A null text is empty; very long texts are searched whole; ids may be null or repeat; a table without candidates, or empty, has no spans; other columns are not read.
    """
    found = cut(candidates(docs, id_col, text_col), "candidates")
    seen = found.select(F.explode("spans").alias("c")).groupBy(
        F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.feats").alias("feats")
    ).agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["feats"]), r["n"]) for r in seen.collect())  # at most 8 * 3**5 * 2**8 rows, whatever the input
    votes: dict = defaultdict(int)
    for kind, v, _, n in rows:
        votes[kind, v] += n
    truth, _ = reliabilities([(k, v, n) for (k, v), n in sorted(votes.items())])
    weights = fit(rows, truth)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in weights[k]]) for k in range(len(KINDS))])

    def stays(c: Column) -> Column:
        w = F.element_at(table, c["kind"] + 1)
        terms = F.transform(c["feats"], lambda x, i: x * F.element_at(w, i + 2))
        odds = F.element_at(w, 1) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
        return c["base"] | (odds >= math.log(accept / (1 - accept)))

    kept = F.filter("spans", stays)
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        ordered, lambda c: F.struct(F.element_at(names, c["k"] + 1).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"))
    )
    return found.select(F.col("id").alias(id_col), spans.alias("spans"), F.size("spans").cast("long").alias("n_candidates"))
