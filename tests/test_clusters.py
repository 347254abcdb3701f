"""Cluster summary rules: trend, recurrence, labels, median."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tixflow.operators import clusters as CL
from tixflow.operators.stats import exact_median


def test_trend_depends_on_size_only(spark):
    rows = []
    for cid, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9]):
        rows += [(cid, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(n)]
    t = spark.createDataFrame(rows, "cluster_id int, opened_at timestamp_ntz")
    got = {r["cluster_id"]: r["trend"] for r in CL.trend(t).collect()}
    assert [got[i] for i in range(8)] == ["Stable", "Stable", "Increasing", "Stable", "Increasing",
                                          "Increasing", "Stable", "Stable"]


def test_recurrence_bands(spark):
    rows = []
    for cid, gap in enumerate([1, 2, 24, 168, 720]):
        rows += [(cid, dt.datetime(2024, 1, 1) + dt.timedelta(hours=gap * i)) for i in range(4)]
    rows += [(9, dt.datetime(2024, 1, 1))]
    t = spark.createDataFrame(rows, "cluster_id int, opened_at timestamp_ntz")
    got = {r["cluster_id"]: r["recurrence"] for r in CL.recurrence(t).collect()}
    assert got == {0: "Continuous / ongoing", 1: "Multiple times per day", 2: "Multiple times per week",
                   3: "Weekly", 4: "Monthly or less", 9: "Insufficient data"}


def test_recurrence_with_duplicate_times(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0, base)] * 3 + [(0, base + dt.timedelta(hours=10))]      # gaps 0, 0, 10 -> median 0
    t = spark.createDataFrame(rows, "cluster_id int, opened_at timestamp_ntz")
    r = CL.recurrence(t).collect()[0]
    assert r["median_gap_hours"] == 0.0 and r["recurrence"] == "Continuous / ongoing"


def test_keyword_label(spark):
    df = spark.createDataFrame([([],), (["disk"],), (["disk full", "log rotation"],)], "k array<string>")
    got = [r[0] for r in df.select(CL.keyword_label(F.col("k"))).collect()]
    assert got == ["Uncategorized Issues", "Disk Issues",
                   "Disk Full / Log Rotation Issues"]


def test_exact_median_matches_pandas(spark):
    import random
    rng = random.Random(7)
    rows = [(g, float(rng.randint(0, 50))) for g in range(3) for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", accuracy=100, verify=True).collect()}
    import statistics
    for g in range(3):
        assert got[g] == pytest.approx(statistics.median([v for gg, v in rows if gg == g]))


def test_recurrence_of_a_hot_cluster(spark):
    import random

    from pyspark.sql import functions as F

    from tixflow.operators.clusters import recurrence
    rng = random.Random(9)
    # one cluster holds most rows and most timestamps; one timestamp holds a third of its rows
    rows = [(0, rng.randrange(0, 3_000_000)) for _ in range(1200)] + [(0, 77)] * 600
    rows += [(1, rng.randrange(0, 900_000)) for _ in range(25)] + [(2, 5)] + [(3, None)] + [(4, 1), (4, 1)]
    t = spark.createDataFrame(rows, "cluster_id int, s long").select(
        "cluster_id", F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("opened_at"))
    got = {r["cluster_id"]: r["median_gap_hours"] for r in recurrence(t).collect()}
    for c in range(5):
        s = sorted(x for k, x in rows if k == c and x is not None)
        gaps = sorted((b - a) / 3600 for a, b in zip(s, s[1:]))
        m = len(gaps)
        want = (gaps[(m - 1) // 2] + gaps[m // 2]) / 2 if m else None
        assert (got[c] is None) == (want is None) and (want is None or abs(got[c] - want) < 1e-9), c
