"""Sliced windows and ranks through buckets equal the plain ones, NULL keys and values included."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hushlake.operators import ordered, reports


def test_sliced_equals_plain(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "a", None]), i, rnd.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(3)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("v").over(w).alias("b"), F.row_number().over(w).cast("long").alias("n"), F.lead("v").over(w).alias("l"))
    cut = F.floor(F.col("o") / 16)
    got = ordered.row_number_sliced(ordered.lag_sliced(df, ["k"], ["o"], "v", cut, "b"), ["k"], ["o"], cut, "n")
    got = ordered.lead_sliced(got, ["k"], ["o"], "v", cut, "l")
    key = str
    assert sorted((tuple(r) for r in got.select("k", "o", "b", "n", "l").collect()), key=key) == sorted(
        (tuple(r) for r in want.collect()), key=key
    )


def test_latency_stats_with_outliers(spark):
    """One far outlier leaves the ranks exact and the buckets about equal; no value dominates a bucket by its spread."""
    rng = random.Random(3)
    groups = {
        "outlier": [rng.random() for _ in range(20_000)] + [1e12],
        "ties": [5.0] * 3_000 + [float(rng.randrange(4)) for _ in range(3_000)],
        "one": [7.25], "two": [-1.0, 3.0], "nulls": [None, None, 2.5, 1.5],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in reports.latency_stats(df, ["k"], "v").collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[k]["samples"] == len(vs)
        for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)):
            assert got[k][name] == round(vs[math.floor(len(vs) * p)], 3), (k, name)
        assert (got[k]["min"], got[k]["max"]) == (round(vs[0], 3), round(vs[-1], 3))
    assert reports.latency_stats(df.limit(0), ["k"], "v").count() == 0
    plan = reports.latency_stats(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1


def test_stage_shares(spark):
    rows = [("s1", "a", 20.0), ("s1", "b", 80.0), ("s1", "c", None), ("s2", "a", 0.25), ("s2", "b", 0.5), (None, "a", 4.0)]
    got = {(r["scan"], r["stage"]): (r["ms"], r["share"]) for r in reports.stage_shares(spark.createDataFrame(rows, "scan string, stage string, ms double"), ["scan"], "stage", "ms").collect()}
    assert got == {
        ("s1", "a"): (20.0, 0.25), ("s1", "b"): (80.0, 1.0), ("s1", "c"): (0.0, 0.0), ("s2", "a"): (0.25, 0.25), ("s2", "b"): (0.5, 0.5), (None, "a"): (4.0, 1.0),
    }
