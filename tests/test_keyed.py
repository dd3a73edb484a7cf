import os

from pyspark.sql import functions as F

from quirelake.streaming import keyed, progress


def records(spark, rows):
    return spark.createDataFrame([(s, i, "src", [], None, None) for s, i in rows], progress.RECORD)


LINKS = [keyed.Link("detected"), keyed.Link("read", lambda r: r.withColumn("source", F.concat("source", F.lit("+text"))))]


def log_of(spark, root, link):
    return sorted((r["seq"], r["image"]) for r in spark.read.parquet(f"{root}/{link}/log").collect())


def test_a_chain_loses_and_doubles_nothing_over_restarts(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "chain")
    progress.append(records(spark, [(1, "a"), (2, "b"), (None, "b")]).coalesce(1), source)
    keyed.run(spark, source, root, LINKS, files_per_batch=1)
    progress.append(records(spark, [(3, "a"), (2, "b"), (1, "a"), (4, "c")]).coalesce(1), source)
    # killed between two batches: the first link's second batch ran, but its commit is lost, and the second link never began
    keyed.run(spark, source, root, LINKS[:1], files_per_batch=1)
    commits = f"{root}/detected/checkpoint/commits"
    for name in os.listdir(commits):
        if name.strip(".").startswith("1"):
            os.remove(f"{commits}/{name}")
    keyed.run(spark, source, root, LINKS, files_per_batch=1)
    keyed.run(spark, source, root, LINKS, files_per_batch=1)
    want = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    assert log_of(spark, root, "detected") == want and log_of(spark, root, "read") == want
    got = {r["image"]: (r["seq"], r["source"]) for r in keyed.state(spark, root, "read").collect()}
    assert got == {"a": (3, "src+text"), "b": (2, "src+text"), "c": (4, "src+text")}
    assert {r["image"]: r["seq"] for r in keyed.seen(spark, root, "detected").collect()} == {"a": 3, "b": 2, "c": 4}


def test_queries_side_by_side(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "chain")
    progress.append(records(spark, [(k, f"i{k % 7}") for k in range(40)]).repartition(4), source)
    os.makedirs(f"{root}/detected/log")
    for _ in range(2):
        for q in keyed.start(spark, source, root, LINKS, files_per_batch=2):
            q.awaitTermination()
    assert {r["image"]: r["seq"] for r in keyed.state(spark, root, "read").collect()} == {f"i{k % 7}": k for k in range(33, 40)}
