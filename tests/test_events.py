import datetime as dt

from quirelake.streaming import events

DAY = dt.datetime(2024, 3, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def play(spark, folder, batches, through):
    """The batches as a stream, each a run of its own that may be killed after it; what was appended."""
    schema = "ts timestamp, user string, value double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        events.fold(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, through, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").collect()


BATCHES = [
    [(at(0), "a", 1.0), (at(10), "a", 1.0), (at(100), "b", 2.0), (None, "a", 9.0)],
    [(at(70), "a", 4.0), (at(45), "b", 8.0), (at(160), "a", 1.0)],  # the watermark is at 40 when these come
    [(at(100), "a", 16.0), (at(20), "b", 32.0), (at(5), "a", 64.0)],  # it is at 100: the first still counts in the window that ends at 120
    [(at(10_000), "end", 0.0)],
]


def test_sliding_windows_under_a_watermark(spark, tmp_path):
    got = play(spark, str(tmp_path), BATCHES, lambda s: events.sliding(s, "60 minutes", "30 minutes", "60 minutes", ["user"], "value"))
    found = {((r["window_start"] - DAY).total_seconds() / 60, r["user"]): (r["n"], r["total"]) for r in got}
    want = {}
    for rows, mark in zip(BATCHES[:3], (-10**9, 40, 100), strict=True):
        for ts, user, value in rows:
            if ts is not None:
                m = (ts - DAY).total_seconds() / 60
                for start in (m // 30 * 30 - 30, m // 30 * 30):
                    if start + 60 > mark:
                        n, total = want.get((start, user), (0, 0.0))
                        want[start, user] = (n + 1, total + value)
    assert found == want


def test_sessions_under_a_watermark(spark, tmp_path):
    got = play(spark, str(tmp_path), BATCHES, lambda s: events.sessions(s, "30 minutes", "60 minutes", ["user"]))
    found = sorted((r["user"], (r["session_start"] - DAY).total_seconds() / 60, (r["session_end"] - DAY).total_seconds() / 60, r["n"]) for r in got)
    # user a: 0 and 10; 70, which is over at 100, as the mark is then; the late 100, still in time; 160. b: 100; 45, in time; 20 and 5 too late
    assert found == [("a", 0, 40, 2), ("a", 70, 100, 1), ("a", 100, 130, 1), ("a", 160, 190, 1), ("b", 45, 75, 1), ("b", 100, 130, 1)]
