import random
from collections import Counter

from pyspark.sql import functions as F

from quirelake.llm.quantiles import LEAST, POINTS, batch_quantiles, estimate, exact_ranks, merge, summarise, thin, value_counts


def made(seed=9):
    """(grp, batch, x): a group with most of the rows, ties, a null group, few rows, one value only."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(8), rng.randrange(100_000)) for _ in range(9_000)]
    rows += [("ties", rng.randrange(3), rng.choice([1, 2, 2, 2, 2, 3, 50])) for _ in range(900)]
    rows += [(None, rng.randrange(2), rng.randrange(-500, 500)) for _ in range(300)]
    rows += [("few", 0, k) for k in range(19)] + [("just", k % 4, k // 2) for k in range(20)] + [("one", 1, 7)] * 500 + [("hot", 0, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp string, batch int, x long").repartition(6)


def test_ranks_are_exact_over_many_parts(spark):
    rows = [r for r in made() if r[2] is not None]
    counts = value_counts(frame(spark, rows), ["grp"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = {(r["grp"], r["x"]): r for r in exact_ranks(counts, ["grp"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for grp in {r[0] for r in rows}:
        own = Counter(r[2] for r in rows if r[0] == grp)
        below = 0
        for nth, x in enumerate(sorted(own), 1):
            r = got.pop((grp, x))
            assert (r["c"], r["below"], r["upto"], r["nth"], r["n"]) == (own[x], below, below + own[x], nth, own.total())
            below += own[x]
    assert not got


def test_merged_bounds_hold_and_are_the_sums_over_parts(spark):
    rows = [r for r in made(2) if r[2] is not None]
    parts = summarise(exact_ranks(value_counts(frame(spark, rows), ["grp", "batch"]), ["grp", "batch"]), ["grp", "batch"])
    points = {}
    for r in parts.collect():
        points.setdefault((r["grp"], r["batch"]), []).append(r)
    once = merge(parts, ["grp"], "batch").collect()
    # the same in two rounds: pairs of batches first
    pairs = merge(parts.withColumn("pair", F.col("batch") % 2), ["grp", "pair"], "batch")
    twice = merge(pairs, ["grp"], "pair").collect()
    for merged in (once, twice):
        for r in merged:
            own = [x for g, _, x in rows if g == r["grp"]]
            below, upto = sum(x < r["x"] for x in own), sum(x <= r["x"] for x in own)
            assert r["lt_lo"] <= below <= r["lt_hi"] and r["le_lo"] <= upto <= r["le_hi"] and r["n"] == len(own)
    for r in once:
        lo = hi = le_hi = 0
        for (g, _), own in points.items():
            if g == r["grp"]:
                own = sorted(own, key=lambda p: p["x"])
                n = own[0]["n"]
                lo += max([p["le_lo"] for p in own if p["x"] <= r["x"]], default=0)
                hi += min([p["lt_hi"] for p in own if p["x"] >= r["x"]], default=n)
                le_hi += next((p["le_hi"] for p in own if p["x"] == r["x"]), min([p["lt_hi"] for p in own if p["x"] > r["x"]], default=n))
        assert (r["le_lo"], r["lt_hi"], r["le_hi"]) == (lo, hi, le_hi)
    small = thin(merge(parts, ["grp"], "batch"), ["grp"], 60)
    assert small.where("grp = 'hot'").count() <= 60 + LEAST


def test_quantiles_of_batches_and_wholes(spark):
    rows = made()
    got = batch_quantiles(frame(spark, rows), ["grp"], "batch").collect()
    cells = Counter()
    for g, b, x in rows:
        if x is not None:
            cells[g, b] += 1
            cells[g, -1] += 1
    assert Counter((r["grp"], r["batch"]) for r in got) == {k: 9 for k, n in cells.items() if n >= 20}
    last = {}
    for r in sorted(got, key=lambda r: r["i"]):
        own = sorted(x for g, b, x in rows if g == r["grp"] and x is not None and r["batch"] in (-1, b))
        distinct = len(set(own))
        assert r["n"] == len(own) and r["target"] == -(-r["i"] * len(own) // 10) and r["exact_x"] == own[r["target"] - 1]
        assert min(LEAST, distinct) <= r["points"] <= min(len(own), 400 if r["batch"] < 0 else POINTS + LEAST)
        assert (r["n_below"], r["n_upto"]) == (sum(x < r["answer"] for x in own), sum(x <= r["answer"] for x in own))
        assert r["rank_error"] == max(0, r["n_below"] + 1 - r["target"], r["target"] - r["n_upto"]) and 1000 * r["rank_error"] <= 50 * len(own)
        assert own[0] <= r["answer"] <= own[-1] and r["answer"] >= last.get((r["grp"], r["batch"]), own[0])
        last[r["grp"], r["batch"]] = r["answer"]


def test_times_clashes_and_empty(spark):
    rows = frame(spark, made())
    plain = sorted(map(str, batch_quantiles(rows, ["grp"], "batch").collect()))
    folded = rows.groupBy("grp", "batch", "x").count().selectExpr("*", "1 AS n", "2 AS c", "3 AS below", "4 AS target", "5 AS lo", "6 AS part")
    assert sorted(map(str, batch_quantiles(folded, ["grp"], "batch", times="count").collect())) == plain
    assert batch_quantiles(rows.limit(0), ["grp"], "batch").count() == 0
    assert estimate(summarise(exact_ranks(value_counts(rows.limit(0), ["grp"]), ["grp"]), ["grp"]), ["grp"]).count() == 0
