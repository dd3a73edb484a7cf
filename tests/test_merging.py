import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import merging, pages
from quirelake.sources.regions import parse_strict
from quirelake.streaming import progress


@pytest.fixture(scope="module")
def page_rows(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for k in range(40):
        gt = [
            {"bbox": [10, 40 * i, 200 + 7 * i, 40 * i + 28], "type": rng.choice(["handwritten", "printed", "formula", "image"]), "text": " ".join("abcd"[: rng.randrange(5)] for _ in range(6))}
            for i in range(rng.randrange(6))
        ]
        pred = [{**g, "text": g["text"][: rng.randrange(1, 20)]} for g in gt if rng.random() < 0.8]
        rows.append((f"p{k}", rng.choice(["a", "b", None]), json.dumps(gt), json.dumps(pred)))
    all_ = spark.createDataFrame(rows, "image string, source string, gt string, pred string")
    want = parse_strict(all_.select("image", "source", F.col("gt").alias("regions")), False)
    got = parse_strict(all_.select("image", F.col("pred").alias("regions")))
    path = str(tmp_path_factory.mktemp("pages") / "rows")
    pages.score_pages(want, got).write.parquet(path)
    return spark.read.parquet(path)


def reports(state):
    out = [merging.metric(state), merging.metric_by_source(state), merging.types(state), merging.quantiles(state, "chars"), merging.quantiles(state, "page_cer", (0.0, 0.5, 1.0))]
    return [sorted(map(str, r.collect())) for r in out]


def test_any_split_and_order_gives_the_unsplit_reports(spark, page_rows, tmp_path):
    whole = merging.merge(merging.partial(page_rows))
    want = reports(whole)
    parts = [merging.partial(page_rows.where(f"pmod(hash(image), 3) = {k}")) for k in range(3)]
    for order in list(itertools.permutations(parts))[:4]:
        assert reports(merging.merge(*order)) == want
    assert reports(merging.merge(merging.merge(parts[2], parts[0]), parts[1])) == want
    for k, part in enumerate(parts):
        merging.write_shard(part, str(tmp_path / "s"), k)
    merging.write_shard(parts[1], str(tmp_path / "s"), 1)  # a shard that ran again
    assert reports(merging.read_shards(spark, str(tmp_path / "s"), 3)) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        merging.read_shards(spark, str(tmp_path / "s"), 4).count()


def test_reports_are_those_of_page_rows(page_rows):
    state = merging.partial(page_rows)
    for got, want in ((merging.metric(state), pages.score(page_rows)), (merging.types(state), pages.by_type(page_rows))):
        a, b = ({r[0] if "type" in r.asDict() else 0: r.asDict() for r in d.collect()} for d in (got, want))
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-9)
    errors = sorted(round(r["page_cer"] * 1e6) for r in page_rows.collect() if r["page_cer"] is not None)
    got = {r["share"]: r["value"] for r in merging.quantiles(state, "page_cer", (0.25, 0.9)).collect()}
    assert all(abs(got[s] - errors[-(-int(s * 100) * len(errors) // 100) - 1]) <= 1 for s in got)


def test_states_of_no_pages(page_rows):
    empty = merging.partial(page_rows.where("false"))
    assert merging.metric(empty).first()["composite"] == 0.0 and merging.types(empty).count() == 0
    assert reports(merging.merge(empty, merging.partial(page_rows))) == reports(merging.partial(page_rows))


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("k"), F.xxhash64("id").alias("h"), F.pmod(F.hash("id"), F.lit(1000)).cast("long").alias("v"), F.col("id").cast("string").alias("image"))
    states = [merging.sketch(progress.shard(rows, s, 4), ["k"], "h", "v") for s in range(4)]
    told = {r["k"]: r for r in merging.sketched(merging.merge_sketches(*states, keys=["k"]), (0.1, 0.9)).collect()}
    for k, r in told.items():
        own = sorted(x["v"] for x in rows.where(F.col("k") == k).select("v").collect())
        assert abs(r["distinct"] - 20_000) <= 0.04 * 20_000
        for share, p in ((0.1, "p10"), (0.9, "p90")):
            assert sum(v < r[p] for v in own) <= (share + 0.03) * len(own) and sum(v <= r[p] for v in own) >= (share - 0.03) * len(own)
