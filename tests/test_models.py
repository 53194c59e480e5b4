"""Invariants of the fitted models on small generated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.functions.scores import geometric_ensemble
from cohortcast.operators import models as md


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x, z = (float(v) for v in rng.normal(size=2))
        y = 2 * x + float(rng.normal())
        rows.append((i, 2000 + i % 4, x, z, y, int(y > 0), int(np.digitize(y, [-2, -0.5, 0.5, 2]))))
    return spark.createDataFrame(rows, "id BIGINT, year INT, x DOUBLE, z DOUBLE, y DOUBLE, hit INT, bucket INT").repartition(3).cache()


def test_classifier_and_importance(spark, data):
    m = md.fit_classifier(data, ["x", "z"], "hit", trees=md.Trees(rounds=3, sample=1.0))
    p = md.probability_of(m, data, "p")
    assert p.where("p < 0 or p > 1").count() == 0 and p.stat.corr("p", "y") > 0.6
    assert md.importance_table(spark, m, ["x", "z"]).first()["feature"] == "x"


def test_quantile_levels_are_ordered(data):
    got = md.fit_leaf_quantiles(data, ["x", "z"], "y", {"lo": 0.2, "hi": 0.8}, depth=2).predict(data).select(
        F.avg((F.col("y") <= F.col("lo")).cast("double")), F.avg((F.col("y") <= F.col("hi")).cast("double")), F.min(F.col("hi") - F.col("lo")), F.count("*")).first()
    assert got[0] == pytest.approx(0.2, abs=0.05) and got[1] == pytest.approx(0.8, abs=0.05) and got[2] > 0 and got[3] == 240


def test_isotonic_is_monotone(spark, data):
    scored = data.withColumn("p", F.lit(1.0) / (1 + F.exp(-F.col("x"))))
    m = md.fit_isotonic(scored, "p", "hit", digits=2)
    ys = [r["y"] for r in md.isotonic_points(spark, m).orderBy("x").collect()]
    assert ys == sorted(ys)
    ends = md.apply_isotonic(m, spark.createDataFrame([(-5.0,), (5.0,)], "p DOUBLE"), "p", "q").orderBy("p").collect()
    assert [r["q"] for r in ends] == pytest.approx([ys[0], ys[-1]])


def test_ordinal_probabilities(data):
    m = md.fit_ordinal(data, ["x", "z"], "bucket", 5)
    rows = data.select("x", m.probabilities().alias("p")).collect()
    for r in rows:
        assert sum(r["p"]) == pytest.approx(1.0) and min(r["p"]) >= 0 and len(r["p"]) == 5
    assert m.slopes[0] > 0.5 > abs(m.slopes[1])


def test_intervals_hold_their_mean(data):
    ms = md.fit_bootstrap(data, "id", ["x"], "bucket", 5, replicates=3, iterations=5)
    rows = data.select(F.explode(F.array(*md.interval_columns(ms, 5))).alias("b")).select("b.*").collect()
    assert len(rows) == 240 * 5 and all(r["p_lo"] <= r["p_hi"] and 0 <= r["p_lo"] and r["p_hi"] <= 1 for r in rows)
    assert data.select(F.avg(md.poisson_weight("id", 1))).first()[0] == pytest.approx(1.0, abs=0.25)


def test_folds_use_the_past(data):
    seen = []
    def fit_predict(train, test):
        seen.append((train.agg(F.max("year")).first()[0], test.select("year").distinct().first()[0]))
        return test.select("id")
    out = md.cross_validate(data, "year", [2002, 2003], fit_predict)
    assert seen == [(2001, 2002), (2002, 2003)] and out.count() == 120


def test_bucket_padding_and_ensemble(data):
    m = md.fit_buckets(data.where("bucket < 3"), ["x", "z"], "bucket", trees=3)
    p = md.bucket_probabilities(m, data, "p", 5)
    assert p.where("size(p) <> 5").count() == 0
    e = p.select(geometric_ensemble(F.col("p"), F.array(*[F.lit(0.2)] * 5)).alias("e")).select(F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert e.where("abs(s - 1) > 1e-9").count() == 0


def test_forward_calibration_sees_earlier_folds_only(data):
    scored = data.withColumn("p", F.lit(0.9) / (1 + F.exp(-3 * F.col("x")))).withColumnRenamed("year", "fold")
    years = [2000, 2001, 2002, 2003]
    got = {r["id"]: r for r in md.calibrate_forward(scored, "fold", years, "p", "hit", "q").collect()}
    assert len(got) == 240 and all(r["q"] == r["p"] for r in got.values() if r["fold"] == 2000)
    flipped = scored.withColumn("hit", F.when(F.col("fold") >= 2002, 1 - F.col("hit")).otherwise(F.col("hit")))
    other = {r["id"]: r for r in md.calibrate_forward(flipped, "fold", years, "p", "hit", "q").collect()}
    assert all(other[i]["q"] == r["q"] for i, r in got.items() if r["fold"] <= 2002) and any(other[i]["q"] != r["q"] for i, r in got.items())
    late = [r for r in got.values() if r["fold"] > 2001]
    brier = lambda c: sum((r[c] - r["hit"]) ** 2 for r in late)
    assert brier("q") <= brier("p") * 1.05


def test_sweep_adds_up_within_a_task(spark):
    """One sum per key and setting from a task, over several pieces of a batch, and small pieces only."""
    import numpy as np

    from cohortcast.operators import evaluate as ev
    assert ev.ROWS_AT_ONCE * len(ev.combiner_settings()) * 8 <= 4 << 20
    rng = np.random.default_rng(4)
    rows = [("p" if i % 3 else "q", *map(float, rng.random(5))) for i in range(1500)]
    df = spark.createDataFrame(rows, "g STRING, p_made_it DOUBLE, p_iso DOUBLE, base_rate DOUBLE, prod_pred DOUBLE, ppg DOUBLE").coalesce(1)
    got = {(r["g"], r["transform"]): r for r in ev.combiner_errors(df, ["g"]).where("transform IN ('identity', 'isotonic')").collect()}
    for g in "pq":
        mine = np.array([r[1:] for r in rows if r[0] == g])
        assert got[(g, "identity")]["n"] == len(mine)
        for name, column in (("identity", 0), ("isotonic", 1)):
            assert abs(got[(g, name)]["err"] - np.abs(mine[:, 4] - mine[:, column] * mine[:, 3]).sum()) < 1e-9


def test_intervals_work_out_each_replicate_once(data):
    """The expression does not grow with its uses of a replicate, and gives numpy's means and quantiles."""
    rng = np.random.default_rng(6)
    ms = [md.OrdinalModel(("x", "z"), tuple(map(float, rng.normal(size=4))), tuple(map(float, rng.normal(size=2)))) for _ in range(12)]
    uses = [len([w for w in str(F.array(*md.interval_columns(some, 5))).lower().split("exp(") if w]) for some in (ms[:4], ms)]
    assert uses[0] == uses[1]
    for r in data.select("x", "z", md.intervals(ms, 5).alias("b")).limit(20).collect():
        above = [1 / (1 + np.exp(-(np.sort(m.thresholds)[::-1] + m.slopes[0] * r["x"] + m.slopes[1] * r["z"]))) for m in ms]
        p = -np.diff(np.column_stack([np.ones(12), above, np.zeros(12)]), axis=1)
        for b in r["b"]:
            mine = p[:, b["bucket"]]
            assert (b["p"], b["p_lo"], b["p_hi"]) == pytest.approx((mine.mean(), *np.quantile(mine, [0.1, 0.9])), abs=1e-12)
