"""Ranks and quantiles against plain Python, in one range and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.operators import ranks, stats


def rows(seed=1, n=700):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        # group 0 holds most rows and one value holds a third of them
        g = 0 if rng.random() < 0.6 else int(rng.integers(1, 4))
        v = 5.0 if rng.random() < 0.33 else float(rng.integers(0, 60))
        out.append((i, g, None if rng.random() < 0.05 else v))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id BIGINT, g INT, v DOUBLE").repartition(5)


def test_percent_rank_and_cdf(data):
    got = {r["id"]: r for r in ranks.cume_dist_in_group(
        ranks.percent_rank_in_group(data, ["g"], "v", "pr"), ["g"], "v", "cd").collect()}
    assert len(got) == 700
    for i, g, v in rows():
        vals = [x[2] for x in rows() if x[1] == g and x[2] is not None] if i % 50 == 0 else None
        if vals is None:
            continue
        if v is None:
            assert got[i]["pr"] is None and got[i]["cd"] is None
        else:
            assert got[i]["pr"] == pytest.approx(sum(x < v for x in vals) / (len(vals) - 1))
            assert got[i]["cd"] == pytest.approx(sum(x <= v for x in vals) / len(vals))


def test_quantiles(data):
    probs = [0.0, 0.1, 0.35, 0.5, 1.0]
    got = {r["g"]: r for r in ranks.exact_quantiles(data, ["g"], "v", probs, list("abcde")).collect()}
    for g in range(4):
        vals = [x[2] for x in rows() if x[1] == g and x[2] is not None]
        for p, name in zip(probs, "abcde"):
            assert got[g][name] == pytest.approx(np.quantile(vals, p))


def test_row_index_is_a_permutation(data):
    got = ranks.row_index_in_group(data.where("v is not null"), ["g"], "v", "id", "at").collect()
    for g in range(4):
        mine = sorted([(r["v"], r["id"], r["at"]) for r in got if r["g"] == g])
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_distribution_against_reference(spark):
    ref = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "g STRING, v DOUBLE")
    ask = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 3.0), ("a", None), ("c", 1.0)], "g STRING, v DOUBLE")
    got = {(r["g"], r["v"]): r["p"] for r in ranks.distribution_against(ask, ref, ["g"], "v", "p").collect()}
    assert got == {("a", 0.5): 0.0, ("a", 2.0): 0.75, ("a", 3.0): 0.75, ("a", None): None, ("c", 1.0): None}


def test_robust_scale_edges(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (2.0, None, 3.0), (4.0, None, 3.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = {r["feature"]: (r["med"], r["scale"]) for r in stats.robust_scale(df, [], ["a", "b", "c"]).collect()}
    assert got["a"] == pytest.approx((2.0, 1.4826))
    assert got["c"] == (3.0, 1.0) and "b" not in got


def test_auc(spark):
    data = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.7), (0, 0.8)]
    df = spark.createDataFrame([("g", y, s) for y, s in data], "g STRING, y INT, s DOUBLE")
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    got = stats.auc_by_group(df, ["g"], "y", "s").first()
    assert got["auc"] == pytest.approx(want)
    precise = [sum(y for y, s in data if s >= p) / sum(s >= p for _, s in data) for p in pos]
    assert got["pr_auc"] == pytest.approx(np.mean(precise))


def test_multi_column_percent_ranks(data):
    x = data.withColumn("u", F.col("v") * -1)
    got = ranks.percent_ranks(x, ["g"], {"v": "pv", "u": "pu"})
    one = ranks.percent_rank_in_group(data, ["g"], "v", "want")
    assert got.join(one.select("id", "want"), "id").where("not (pv <=> want)").count() == 0


NAN, INF = float("nan"), float("inf")
EXTREME = [NAN, -INF, INF, 0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, 1.0 + 2 ** -52, 1.0 - 2 ** -53, -1.0, 1e15, 1e15 + 1, 1e308, -1e308, 7.25, 7.25, 7.25, None]


def order(v):
    return (1, 0.0) if v != v else (0, v)


def test_extreme_values(spark):
    rows = [(i, k, v) for k in ("a", None) for i, v in enumerate(EXTREME * 3)]
    df = spark.createDataFrame(rows, "id INT, k STRING, v DOUBLE").repartition(4)
    counts = df.where("v is not null").groupBy("k", "v").count().withColumnRenamed("count", "n")
    got = {(r["k"], repr(r["v"] + 0.0)): (r["n_below"], r["n_total"]) for r in ranks.prefix_counts(counts, ["k"], "v", ["n"]).collect()}
    known = [v for v in EXTREME * 3 if v is not None]
    for k in ("a", None):
        for v in known:
            assert got[k, repr(v + 0.0)] == (sum(order(x) < order(v) for x in known), len(known)), v
    shares = ranks.distribution_against(df, df, ["k"], "v", "p").collect()
    assert len(shares) == len(rows) and all((r["p"] is None) == (r["v"] is None) for r in shares)
    q = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], "v", [0.0, 1.0], ["lo", "hi"]).collect()}
    assert q[None]["lo"] == q["a"]["lo"] == -INF and q["a"]["hi"] == INF


def test_close_long_keys(spark):
    rows = [(2 ** 60 + i, 1) for i in range(50)] + [(-(2 ** 60) - i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "v BIGINT, n INT")
    got = {r["v"]: r["n_below"] for r in ranks.prefix_counts(df, [], "v", ["n"]).collect()}
    assert got == {v: sum(m for w, m in rows if w < v) for v, _ in rows}


def test_nothing_runs_before_the_caller_asks(spark, data):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    ranks.distribution_against(data, data, ["g"], "v", "p")
    ranks.exact_quantiles(data, ["g"], "v", [0.5], ["m"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


@pytest.mark.parametrize("offset,step", [(1.7e15, 1.0), (1e12, 1.0), (-3e9, 0.25), (0.0, 1e-300)])
def test_quantiles_of_offset_values(spark, offset, step):
    """Timestamps and large ids share few ranges of the scale; the even split inside a range keeps them apart."""
    rng = np.random.default_rng(4)
    values = [[offset + step * float(v) for v in rng.integers(0, 50_000, 700)] + [offset] * 300 for _ in range(3)]
    df = spark.createDataFrame([(g if g else None, v) for g, vs in enumerate(values) for v in vs], "g INT, v DOUBLE")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 0.933], ["a", "b", "c"]).collect()}
    for g, vs in enumerate(values):
        assert got[g if g else None] == pytest.approx(tuple(np.quantile(vs, [0.0, 0.5, 0.933])), rel=1e-15, abs=1e-310)


def test_percentages_that_end_in_a_half(spark):
    """100 * 115 / 200 is 57.5, 115 / 200 * 100 falls short of it."""
    df = spark.range(200).selectExpr("'g' AS g", "CAST(id AS DOUBLE) AS v")
    for out in (ranks.cume_dist_in_group(df, ["g"], "v", "p", 100), ranks.distribution_against(df, df, ["g"], "v", "p", 100)):
        got = {r["v"]: r["p"] for r in out.collect()}
        assert all(got[float(i)] == 100 * (i + 1) / 200 for i in range(200))
        assert out.where("v = 114").select(F.bround("p").cast("int")).first()[0] == 58
