"""Evaluation families on out-of-sample rows."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators import evaluate as ev
from cohortcast.operators.grouped import attach
from cohortcast.operators.ranks import exact_quantiles
from cohortcast.operators.stats import auc_by_group
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import materialize

METRIC = ("mae", "rmse", "cor", "bias", "accuracy", "brier")
METRIC_SQL = """count(*) AS n, round(avg(abs(exp_ppg - ppg)), 6) AS mae, round(sqrt(avg(pow(exp_ppg - ppg, 2))), 6) AS rmse,
    round(corr(ppg, exp_ppg), 6) AS cor, round(avg(exp_ppg - ppg), 6) AS bias,
    round(avg(CASE WHEN (p_made_it > 0.5) = (made_it = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(pow(p_made_it - made_it, 2)), 6) AS brier"""


def rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in df.columns if c in METRIC})


@query("temporal_folds", """
    WITH o AS (SELECT entity_id, position, cohort_year, made_it FROM outcome),
    f AS (SELECT o.*, fold, CASE WHEN cohort_year = fold THEN 'test' ELSE 'train' END AS role FROM o, (VALUES (1997), (1998), (1999), (2000)) v(fold) WHERE cohort_year <= fold),
    x AS (SELECT o.*, 10000 + cut AS fold, CASE WHEN cohort_year <= cut THEN 'train' ELSE 'test' END AS role FROM o, (VALUES (1996), (1998)) v(cut) WHERE cohort_year <= cut + 3),
    a AS (SELECT * FROM f UNION ALL SELECT * FROM x)
    SELECT CAST(fold AS INTEGER) AS fold, position, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test,
           count(*) FILTER (WHERE role = 'train' AND made_it = 1) AS n_positive FROM a GROUP BY ALL
    HAVING n_train >= 40 AND n_test >= 5 AND n_positive >= 5""")
def temporal_folds(spark, d):
    o = base.outcome(spark, d).select("entity_id", "position", "cohort_year", "made_it")
    rolling = ev.rolling_folds(o, "cohort_year", [1997, 1998, 1999, 2000])
    expanding = ev.expanding_folds(o, "cohort_year", [1996, 1998], presets.FOLD_HORIZON).withColumn("fold", F.col("fold") + 10000)
    return ev.usable_folds(rolling.unionByName(expanding), ["position"], "made_it", 40, 5, 5)


@query("metrics_rollup", f"SELECT 'ALL' AS position, {METRIC_SQL} FROM oos UNION ALL SELECT position, {METRIC_SQL} FROM oos GROUP BY position")
def metrics_rollup(spark, d):
    return rounded(ev.error_table(base.oos(spark, d), "position", ev.error_aggregates("ppg", "exp_ppg", "p_made_it", "made_it")))


@query("metrics_by_year", f"SELECT CAST(test_year AS VARCHAR) AS test_year, {METRIC_SQL} FROM oos GROUP BY test_year UNION ALL SELECT 'ALL', {METRIC_SQL} FROM oos")
def metrics_by_year(spark, d):
    o = base.oos(spark, d).withColumn("test_year", F.col("test_year").cast("string"))
    return rounded(ev.error_table(o, "test_year", ev.error_aggregates("ppg", "exp_ppg", "p_made_it", "made_it")))


@query("auc_rank", """
    SELECT o.position, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, round(sum(CASE WHEN made_it = 1 THEN r END) / any_value(n_pos * n_neg) - (any_value(n_pos) + 1) / (2.0 * any_value(n_neg)), 6) AS auc,
           round(sum(CASE WHEN made_it = 1 THEN found / CAST(above AS DOUBLE) END) / any_value(n_pos), 6) AS pr_auc
    FROM (SELECT position, made_it, rank() OVER w + (count(*) OVER (PARTITION BY position, s) - 1) / 2.0 AS r,
                 count(*) FILTER (WHERE made_it = 1) OVER (PARTITION BY position ORDER BY s DESC) AS found, count(*) OVER (PARTITION BY position ORDER BY s DESC) AS above,
                 count(*) FILTER (WHERE made_it = 1) OVER (PARTITION BY position) AS n_pos, count(*) FILTER (WHERE made_it = 0) OVER (PARTITION BY position) AS n_neg
          FROM (SELECT position, made_it, round(p_made_it - 0.4 * made_it, 2) AS s FROM oos) WINDOW w AS (PARTITION BY position ORDER BY s)) o GROUP BY o.position""")
def auc_rank(spark, d):
    o = base.oos(spark, d).select("position", "made_it", F.round(F.col("p_made_it") - 0.4 * F.col("made_it"), 2).alias("s"))
    return auc_by_group(o, ["position"], "made_it", "s").withColumns({c: r6(F.col(c)) for c in ("auc", "pr_auc")})


def bins_sql(x):
    b = presets.CALIBRATION_BREAKS
    return "CASE " + f"WHEN {x} < {b[0]} THEN NULL " + " ".join(f"WHEN {x} <= {h} THEN {i}" for i, h in enumerate(b[1:])) + " END"


@query("calibration_bins", f"""
    SELECT position, bin, count(*) AS n, round(avg(p_made_it), 6) AS predicted, round(avg(made_it), 6) AS observed
    FROM (SELECT *, CAST({bins_sql('p_made_it')} AS INTEGER) AS bin FROM oos) WHERE bin IS NOT NULL GROUP BY position, bin HAVING count(*) >= 3""")
def calibration_bins(spark, d):
    out = ev.calibration_table(base.oos(spark, d), ["position"], "p_made_it", "made_it", presets.CALIBRATION_BREAKS, 3)
    return out.withColumns({"predicted": r6(F.col("predicted")), "observed": r6(F.col("observed"))})


@query("multiclass_metrics", """
    WITH b AS (SELECT *, CAST((entity_id * 17 + 3) % 5 AS INTEGER) AS obs, row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, bucket) AS rk FROM bucket_probs),
    r AS (SELECT entity_id, position, any_value(obs) AS obs, max(CASE WHEN bucket = obs THEN p END) AS po, max(CASE WHEN bucket = obs THEN q END) AS qo,
                 max(CASE WHEN rk = 1 THEN bucket END) AS t1, max(CASE WHEN rk = 2 THEN bucket END) AS t2 FROM b GROUP BY ALL)
    SELECT position, count(*) AS n, round(avg(-ln(least(1 - 1e-12, greatest(1e-12, po)))), 6) AS log_loss, round(avg(CASE WHEN t1 = obs THEN 1.0 ELSE 0.0 END), 6) AS top1,
           round(avg(CASE WHEN obs IN (t1, t2) THEN 1.0 ELSE 0.0 END), 6) AS top2, round(avg(CASE WHEN abs(t1 - obs) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS adjacent,
           round(avg(greatest(po, qo) - least(po, qo)), 6) AS width,
           round(avg(CASE WHEN po * 0.5 + qo * 0.5 + (t1 - obs) * 0.05 BETWEEN least(po, qo) AND greatest(po, qo) THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM r GROUP BY position""")
def multiclass_metrics(spark, d):
    b = base.bucket_probs(spark, d).withColumn("obs", ((F.col("entity_id") * 17 + 3) % 5).cast("int"))
    m = ev.multiclass_row_metrics(F.col("p"), F.col("obs"))
    po, qo = F.get("p", F.col("obs")), F.get("q", F.col("obs"))
    top1 = F.array_position("p", F.array_max("p")) - 1
    probe = po * 0.5 + qo * 0.5 + (top1 - F.col("obs")) * 0.05
    lo, hi = F.least(po, qo), F.greatest(po, qo)
    return b.groupBy("position").agg(
        F.count("*").alias("n"), *[r6(F.avg(v)).alias(k) for k, v in m.items()], r6(F.avg(hi - lo)).alias("width"),
        r6(F.avg(probe.between(lo, hi).cast("double"))).alias("coverage"))


@query("pinball_loss", """
    SELECT position, round(avg(greatest(0.7 * (ppg - exp_ppg), -0.3 * (ppg - exp_ppg))), 6) AS pinball_70,
           round(avg(greatest(0.5 * (ppg - exp_ppg), -0.5 * (ppg - exp_ppg))), 6) AS pinball_50 FROM oos GROUP BY position""")
def pinball_loss(spark, d):
    a, p = F.col("ppg"), F.col("exp_ppg")
    return base.oos(spark, d).groupBy("position").agg(
        *[r6(F.avg(ev.pinball(a, p, t))).alias(f"pinball_{int(t * 100)}") for t in (0.7, 0.5)])


@query("metrics_by_round", """
    SELECT CASE WHEN round = 1 THEN 'Round 1' WHEN round = 2 THEN 'Round 2' WHEN round = 3 THEN 'Round 3' ELSE 'Rounds 4-7' END AS round_group,
           count(*) AS n, round(avg(abs(exp_ppg - ppg)), 6) AS mae, round(avg(made_it), 6) AS hit_rate, round(avg(ppg), 6) AS actual, round(avg(exp_ppg), 6) AS expected
    FROM oos GROUP BY 1""")
def metrics_by_round(spark, d):
    r = F.col("round")
    label = F.when(r <= 3, F.concat(F.lit("Round "), r.cast("string"))).otherwise("Rounds 4-7")
    return base.oos(spark, d).groupBy(label.alias("round_group")).agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(F.col("exp_ppg") - F.col("ppg")))).alias("mae"),
        r6(F.avg("made_it")).alias("hit_rate"), r6(F.avg("ppg")).alias("actual"), r6(F.avg("exp_ppg")).alias("expected"))


PROBS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@query("residual_quantiles", "SELECT position, " + ", ".join(
    f"round(quantile_cont(exp_ppg - ppg, {p}), 6) AS q{int(p * 100):02d}" for p in PROBS) + " FROM oos GROUP BY position")
def residual_quantiles(spark, d):
    o = base.oos(spark, d).select("position", (F.col("exp_ppg") - F.col("ppg")).alias("residual"))
    names = [f"q{int(p * 100):02d}" for p in PROBS]
    return exact_quantiles(o, ["position"], "residual", PROBS, names).select("position", *[r6(F.col(n)).alias(n) for n in names])


@query("metrics_extremes", """
    WITH g AS (SELECT position, test_year, round(avg(abs(exp_ppg - ppg)), 9) AS mae FROM oos GROUP BY ALL)
    SELECT position, arg_min(test_year, (mae, test_year)) AS best_year, arg_max(test_year, (mae, test_year)) AS worst_year,
           round(min(mae), 6) AS best_mae, round(max(mae), 6) AS worst_mae FROM g GROUP BY position""")
def metrics_extremes(spark, d):
    g = base.oos(spark, d).groupBy("position", "test_year").agg(F.round(F.avg(F.abs(F.col("exp_ppg") - F.col("ppg"))), 9).alias("mae"))
    key = F.struct("mae", "test_year")
    return g.groupBy("position").agg(
        F.min_by("test_year", key).alias("best_year"), F.max_by("test_year", key).alias("worst_year"),
        r6(F.min("mae")).alias("best_mae"), r6(F.max("mae")).alias("worst_mae"))


@query("leakage_compare", """
    WITH strict AS (SELECT q.entity_id, avg(p.ppg) AS m FROM outcome q JOIN outcome p ON p.position = q.position AND p.school_id = q.school_id AND p.cohort_year < q.cohort_year GROUP BY 1),
    leaky AS (SELECT q.entity_id, avg(p.ppg) AS m FROM outcome q JOIN outcome p ON p.position = q.position AND p.school_id = q.school_id AND p.entity_id <> q.entity_id GROUP BY 1)
    SELECT o.position, count(s.m) AS n_strict, count(l.m) AS n_leaky, round(avg(abs(o.ppg - s.m)), 6) AS mae_strict, round(avg(abs(o.ppg - l.m)), 6) AS mae_leaky,
           round(corr(o.ppg, s.m), 6) AS cor_strict, round(corr(o.ppg, l.m), 6) AS cor_leaky
    FROM outcome o LEFT JOIN strict s USING (entity_id) LEFT JOIN leaky l USING (entity_id) GROUP BY o.position""")
def leakage_compare(spark, d):
    """The same pool estimate with earlier years only and with every other row."""
    from pyspark.sql import Window
    o = materialize(base.outcome(spark, d).select("entity_id", "position", "school_id", "cohort_year", "ppg"), "leakage")
    keys = ["position", "school_id"]
    years = o.groupBy(*keys, "cohort_year").agg(F.count("*").alias("n"), F.sum("ppg").alias("s"))
    before = Window.partitionBy(*keys).orderBy("cohort_year").rowsBetween(Window.unboundedPreceding, -1)
    past = years.select(*keys, "cohort_year", (F.sum("s").over(before) / F.sum("n").over(before)).alias("strict"))
    total = o.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("ppg").alias("__s"))
    both = attach(attach(o, past, [*keys, "cohort_year"]), total, keys).withColumn(
        "leaky", F.try_divide(F.col("__s") - F.col("ppg"), F.col("__n") - 1))
    def mae(c):
        return r6(F.avg(F.abs(F.col("ppg") - F.col(c))))
    return both.groupBy("position").agg(
        F.count("strict").alias("n_strict"), F.count("leaky").alias("n_leaky"), mae("strict").alias("mae_strict"), mae("leaky").alias("mae_leaky"),
        r6(F.corr("ppg", "strict")).alias("cor_strict"), r6(F.corr("ppg", "leaky")).alias("cor_leaky"))
