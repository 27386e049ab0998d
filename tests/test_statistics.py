import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions import agreement as stat
from voxtally.operators import agreement
from voxtally.operators.order_statistics import exact_percentiles, narrowed, order_statistics

PROBS = {"p0": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p100": 1.0}


def test_percentiles_equal_numpy_with_one_hot_group_and_many_ties(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.normal(size=4000), "ties": rng.integers(0, 3, size=500).astype(float),
        "one": np.array([4.25]), "two": np.array([1.0, 2.0]), "flat": np.full(50, 7.0),
        "wide": np.array([-1e300, 0.0, 5e-324, 1e300]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    for options in ({}, {"bound": 64}, {"bound": 4, "ranges": 2}):
        got = {r.k: r for r in exact_percentiles(df, ["k"], "v", PROBS, **options).collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            assert got[k].n == len(values)
            for name, p in PROBS.items():
                assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300), (k, name)


def test_one_group_is_narrowed_in_several_rounds(spark):
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 50 = 7 THEN 'few' WHEN id % 50 < 48 THEN 'hot' END AS k",
        "CASE WHEN id % 11 = 0 THEN 5D ELSE cast(xxhash64(id) % 100000 AS DOUBLE) / 7 END AS v")
    ranks = {"median": lambda n: F.lit(0.5) * (n - 1), "p99": lambda n: F.lit(0.99) * (n - 1), "last": lambda n: n - 1}
    freq = df.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows, rounds = narrowed(freq, ["k"], ranks, bound=20, ranges=4)
    sizes = rows.groupBy("k", "_range").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_start").alias("starts"))
    assert rounds >= 4
    worst = sizes.agg(F.max("n"), F.max("starts")).first()
    assert worst[0] <= 20 and worst[1] == 1
    assert rows.count() < 20 * 3 * 6  # three kinds of group, six wanted ranks at most
    want = {r.k: r for r in df.groupBy("k").agg(
        F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.99).alias("p99"), F.max("v").alias("last")).collect()}
    for options in ({"bound": 20, "ranges": 4}, {"bound": 100}, {}):
        got = {r.k: r for r in order_statistics(df, ["k"], "v", ranks, **options).collect()}
        assert set(got) == {"hot", "few", None}
        for k, r in got.items():
            assert (r.median, r.p99, r["last"]) == pytest.approx((want[k].median, want[k].p99, want[k]["last"]), rel=1e-12)


def test_global_order_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (5, 3, 9, 1, 7, 7, 2)], "v INT")
    row = order_statistics(df, [], "v", {
        "low": lambda n: F.floor(n / 3), "high": lambda n: F.floor(2 * n / 3)}).first()
    ordered = sorted((5, 3, 9, 1, 7, 7, 2))
    assert (row.low, row.high, row.n) == (ordered[2], ordered[4], 7)


def ccc(spark, pairs):
    df = spark.createDataFrame(pairs, "x DOUBLE, y DOUBLE")
    return df.agg(stat.concordance(F.col("x"), F.col("y")).alias("c")).first().c


def test_concordance(spark):
    xs = [1.0, 2.0, 4.0, 8.0]
    mean = sum(xs) / 4
    assert ccc(spark, [(x, x) for x in xs]) == pytest.approx(1.0)
    assert ccc(spark, [(x, 2 * mean - x) for x in xs]) == pytest.approx(-1.0)
    assert ccc(spark, [(3.0, 3.0), (3.0, 3.0)]) is None
    assert ccc(spark, [(3.0, 4.0)]) is None
    assert ccc(spark, [(x, x) for x in xs] + [(9.0, None), (None, 1.0), (math.nan, 2.0)]) == pytest.approx(1.0)
    assert ccc(spark, [(x, x + 1) for x in xs]) < 1.0


def test_limits_keep_every_compartment(spark):
    pairs = agreement.pair_differences(spark.createDataFrame(
        [("a", 1, "WT", 10.0, 8.0, 5.0, 4.0), ("b", 1, "WT", 20.0, 25.0, 6.0, 9.0), ("a", 2, "TC", 1.0, 1.0, 1.0, 1.0)],
        "subject_id STRING, label INT, compartment STRING, pct_pred DOUBLE, pct_ref DOUBLE, vol_pred DOUBLE, vol_ref DOUBLE"))
    got = {r.compartment: r for r in agreement.limits_of_agreement(pairs).collect()}
    assert set(got) == {"WT", "TC", "ET"}
    sd = np.std([2.0, -5.0], ddof=1)
    assert got["WT"].std_diff_pct == pytest.approx(sd)
    assert got["WT"].loa_upper_pct == pytest.approx(-1.5 + 1.96 * sd)
    assert (got["WT"].n_pairs, got["WT"].n_subjects, got["WT"].n_regions) == (2, 2, 1)
    assert got["TC"].std_diff_pct is None and got["TC"].loa_lower_pct is None and got["TC"].n_pairs == 1
    assert got["ET"].n_pairs == 0 and got["ET"].ccc is None


def test_dice_and_jaccard_identity(spark):
    cells = spark.createDataFrame(
        [("s", p, g) for p, g in [(4, 4), (4, 0), (1, 2), (2, 1), (0, 4), (0, 0)]],
        "subject_id STRING, pred INT, ref INT")
    for r in agreement.overlap_metrics(agreement.confusion_counts(cells)).collect():
        assert r.dice == pytest.approx(2 * r.jaccard / (1 + r.jaccard))
        assert r.n_grid == 6
    both_empty = cells.withColumns({"pred": F.lit(0), "ref": F.lit(0)})
    row = agreement.overlap_metrics(agreement.confusion_counts(both_empty)).first()
    assert row.dice is None and row.jaccard is None and row.sensitivity is None and row.specificity == 1.0


def test_shape_mismatch_aborts(spark):
    voxel = spark.createDataFrame([("s", 0, 0, 0, 4)], "subject_id STRING, x INT, y INT, z INT, label INT")
    grids = spark.createDataFrame([("s", [4, 4, 4]), ("s", [5, 4, 4])], "subject_id STRING, shape ARRAY<INT>")
    with pytest.raises(Exception, match="shape mismatch"):
        agreement.aligned_pair(voxel, voxel, grids).collect()


def test_infinite_values_never_make_nan(spark):
    inf = math.inf
    rows = [("a", 1.0), ("a", inf), ("a", inf), ("b", -inf), ("b", 2.0), ("c", -inf), ("c", inf), ("d", 3.0), ("d", inf)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"q1": 0.25, "q3": 0.75}).collect()}
    assert (got["a"].q1, got["a"].q3) == (inf, inf)
    assert (got["b"].q1, got["b"].q3) == (-inf, -inf)
    assert (got["c"].q1, got["c"].q3) == (-inf, -inf)
    assert (got["d"].q1, got["d"].q3) == (inf, inf)
