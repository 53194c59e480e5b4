"""Window and statistics families."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.functions.scores import composite_score
from cohortcast.operators import grouped, ranks, stats
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import materialize


@query("center_in_group", """
    SELECT entity_id, round(age - avg(age) OVER (PARTITION BY cohort_year), 6) AS age_centered FROM measures""")
def center_in_group(spark, d):
    m = base.measures(spark, d).select("entity_id", "cohort_year", "age")
    return grouped.center_in_group(m, ["cohort_year"], "age", "age_centered").select("entity_id", r6(F.col("age_centered")).alias("age_centered"))


@query("era_zscore", """
    SELECT entity_id, round(CASE WHEN stddev_samp(yards_final) OVER w > 0 THEN (yards_final - avg(yards_final) OVER w) / stddev_samp(yards_final) OVER w
             ELSE yards_final - avg(yards_final) OVER w END, 6) AS yards_z,
           round(CASE WHEN stddev_samp(forty) OVER w > 0 THEN (forty - avg(forty) OVER w) / stddev_samp(forty) OVER w
             ELSE forty - avg(forty) OVER w END, 6) AS forty_z
    FROM features WINDOW w AS (PARTITION BY cohort_year)""")
def era_zscore(spark, d):
    f = base.features(spark, d).select("entity_id", "cohort_year", "yards_final", "forty")
    z = grouped.zscore_in_group(f, ["cohort_year"], ["yards_final", "forty"])
    return z.select("entity_id", r6(F.col("yards_final_z")).alias("yards_z"), r6(F.col("forty_z")).alias("forty_z"))


@query("standardize_train_params", """
    WITH p AS (SELECT avg(weight) m, stddev_samp(weight) s, avg(rating) m2, stddev_samp(rating) s2 FROM measures WHERE cohort_year < 1999)
    SELECT entity_id, round((weight - m) / s, 6) AS weight_std, round((rating - m2) / s2, 6) AS rating_std FROM measures, p WHERE cohort_year >= 1999""")
def standardize_train_params(spark, d):
    m = base.measures(spark, d).select("entity_id", "cohort_year", "weight", "rating")
    out = stats.standardize_with(m.where("cohort_year >= 1999"), m.where("cohort_year < 1999"), ["weight", "rating"])
    return out.select("entity_id", r6(F.col("weight_std")).alias("weight_std"), r6(F.col("rating_std")).alias("rating_std"))


@query("ecdf_against_ref", """
    SELECT c.entity_id, CASE WHEN c.v IS NULL THEN NULL ELSE CAST(round_even(100.0 * (
             SELECT count(*) FROM features r WHERE r.position = c.position AND r.cohort_year < 1999 AND r.yards_final <= c.v)
             / (SELECT count(*) FROM features r WHERE r.position = c.position AND r.cohort_year < 1999 AND r.yards_final IS NOT NULL), 0) AS INTEGER) END AS yards_pct
    FROM (SELECT entity_id, position, yards_final AS v FROM features WHERE cohort_year >= 1999) c""")
def ecdf_against_ref(spark, d):
    f = base.features(spark, d).select("entity_id", "position", "cohort_year", "yards_final")
    out = ranks.distribution_against(f.where("cohort_year >= 1999"), f.where("cohort_year < 1999"), ["position"], "yards_final", "__p", 100)
    return out.select("entity_id", F.bround("__p").cast("int").alias("yards_pct"))


ROBUST = ("yards_final", "ypr", "forty", "weight")


@query("robust_scale", " UNION ALL ".join(f"""
    SELECT position, '{c}' AS feature, round(med, 6) AS med, round(CASE WHEN mad > 0 THEN mad * 1.4826 ELSE 1 END, 6) AS scale FROM (
      SELECT position, any_value(m) AS med, median(abs({c} - m)) AS mad FROM (
        SELECT position, {c}, median({c}) OVER (PARTITION BY position) AS m FROM features WHERE {c} IS NOT NULL) GROUP BY position)""" for c in ROBUST))
def robust_scale(spark, d):
    out = stats.robust_scale(base.features(spark, d), ["position"], ROBUST)
    return out.select("position", "feature", r6(F.col("med")).alias("med"), r6(F.col("scale")).alias("scale"))


@query("pairwise_cov", """
    WITH y AS (SELECT DISTINCT position, cohort_year FROM features),
    v AS (SELECT position, cohort_year, entity_id, 0 AS i, CAST(yards_final / 100 AS DOUBLE) AS x FROM features
          UNION ALL SELECT position, cohort_year, entity_id, 1, ypr FROM features
          UNION ALL SELECT position, cohort_year, entity_id, 2, forty FROM features)
    SELECT y.position, y.cohort_year AS cohort, a.i, b.i AS j, count(a.x + b.x) AS n,
           round(covar_samp(CASE WHEN b.x IS NOT NULL THEN a.x END, CASE WHEN a.x IS NOT NULL THEN b.x END), 6) AS cov
    FROM y JOIN v a ON a.position = y.position AND a.cohort_year < y.cohort_year
    JOIN v b ON b.entity_id = a.entity_id AND b.i >= a.i GROUP BY ALL""")
def pairwise_cov(spark, d):
    f = base.features(spark, d).select("position", "cohort_year", (F.col("yards_final") / 100).alias("a"), F.col("ypr").alias("b"), F.col("forty").alias("c"))
    out = stats.past_covariance(materialize(f, "cov-input"), ["position"], "cohort_year", ["a", "b", "c"])
    first = F.min("cohort").over(Window.partitionBy("position", "i", "j"))
    return out.withColumn("__first", first).where("cohort > __first").select("position", "cohort", "i", "j", "n", r6(F.col("cov")).alias("cov"))


PCT = "CASE WHEN {0} IS NULL THEN NULL ELSE CAST(rank() OVER (PARTITION BY position ORDER BY {0} NULLS LAST) - 1 AS DOUBLE) / nullif(count({0}) OVER (PARTITION BY position) - 1, 0) END"


@query("prospect_score", f"""
    WITH b AS (SELECT entity_id, max(CASE WHEN bucket = 0 THEN p END) AS p_bust, sum(CASE WHEN bucket >= 3 THEN p END) AS upside FROM bucket_probs GROUP BY 1),
    x AS (SELECT o.entity_id, position, p_made_it, round(exp_ppg, 9) AS e, coalesce(round(comp_ppg, 9), 0) AS c,
                 CASE WHEN o.entity_id % 8 <> 0 THEN p_bust END AS p_bust, CASE WHEN o.entity_id % 8 <> 0 THEN round(upside, 9) END AS up,
                 CASE WHEN o.entity_id % 9 <> 0 THEN (o.entity_id % 11) / 10.0 END AS comp_bust FROM oos o JOIN b USING (entity_id)),
    y AS (SELECT *, coalesce(up, 0) AS u0 FROM x),
    z AS (SELECT *, {PCT.format('u0')} * 100 AS ru, {PCT.format('e')} * 100 AS re, {PCT.format('c')} * 100 AS rc FROM y)
    SELECT entity_id, position, round(CASE WHEN up IS NOT NULL AND p_bust IS NOT NULL
             THEN 0.35 * ru + 0.30 * re + 0.15 * (1 - coalesce(p_bust, 0.3)) * 100 + 0.10 * rc + 0.10 * (1 - coalesce(comp_bust, 0.5)) * 100
             ELSE 0.40 * least(100, greatest(0, (p_made_it - 0.5) / 0.5 * 100)) + 0.35 * re + 0.15 * rc + 0.10 * (1 - coalesce(comp_bust, 0.5)) * 100 END, 6) AS score
    FROM z""")
def prospect_score(spark, d):
    e = F.col("entity_id")
    probs = base.bucket_probs(spark, d).select("entity_id", F.col("p")[0].alias("p_bust"), (F.col("p")[3] + F.col("p")[4]).alias("up"))
    has = e % 8 != 0
    x = base.oos(spark, d).join(probs, "entity_id").select(
        "entity_id", "position", "p_made_it", F.round("exp_ppg", 9).alias("e"),
        F.coalesce(F.round("comp_ppg", 9), F.lit(0.0)).alias("c"), F.when(has, F.col("p_bust")).alias("p_bust"),
        F.coalesce(F.when(has, F.round("up", 9)), F.lit(0.0)).alias("u0"), has.alias("has_buckets"),
        F.when(e % 9 != 0, (e % 11) / 10.0).alias("comp_bust"))
    x = ranks.percent_ranks(materialize(x, "score-inputs"), ["position"], {"u0": "ru", "e": "re", "c": "rc"})
    score = composite_score(F.col("ru") * 100, F.col("re") * 100, F.col("rc") * 100, F.col("p_bust"), F.col("comp_bust"),
                            F.col("p_made_it"), F.col("has_buckets"))
    return x.select("entity_id", "position", r6(score).alias("score"))


LINE_SQL = """SELECT position, regr_intercept(ppg, exp_ppg) AS cal_a, regr_slope(ppg, exp_ppg) AS cal_b, count(*) AS cal_n
              FROM oos WHERE test_year <= 1999 GROUP BY position HAVING count(*) >= 20"""


@query("group_calibration_line", f"SELECT position, round(cal_a, 6) AS cal_a, round(cal_b, 6) AS cal_b, cal_n FROM ({LINE_SQL})")
def group_calibration_line(spark, d):
    out = stats.calibration_lines(base.oos(spark, d).where("test_year <= 1999"), ["position"], "exp_ppg", "ppg", presets.MIN_CALIBRATION_ROWS)
    return out.select("position", r6(F.col("cal_a")).alias("cal_a"), r6(F.col("cal_b")).alias("cal_b"), "cal_n")


@query("value_score", f"""
    WITH l AS ({LINE_SQL}), c AS (SELECT o.entity_id, o.position, coalesce(cal_a, 0) + coalesce(cal_b, 1) * exp_ppg AS cal FROM oos o LEFT JOIN l ON l.position = o.position),
    v AS (SELECT *, round(cal - quantile_cont(cal, 0.35) OVER (PARTITION BY position), 9) AS vorp FROM c)
    SELECT entity_id, position, round(vorp, 6) AS vorp, CAST(round_even(100 * cume_dist() OVER (ORDER BY vorp), 0) AS INTEGER) AS value_score FROM v""")
def value_score(spark, d):
    o = base.oos(spark, d).select("entity_id", "position", "test_year", "exp_ppg", "ppg")
    out = stats.value_score(o, "position", "exp_ppg", "ppg", F.col("test_year") <= 1999, presets.MIN_CALIBRATION_ROWS,
                            presets.REPLACEMENT_QUANTILE, "value_score")
    return out.select("entity_id", "position", r6(F.col("vorp")).alias("vorp"), "value_score")


@query("naive_baseline", """
    WITH f AS (SELECT position, regr_intercept(ppg, ln(slot + 1)) a, regr_slope(ppg, ln(slot + 1)) b FROM outcome GROUP BY position)
    SELECT o.position, round(any_value(a), 6) AS intercept, round(any_value(b), 6) AS slope, round(sqrt(avg(pow(ppg - a - b * ln(slot + 1), 2))), 6) AS rmse
    FROM outcome o JOIN f USING (position) GROUP BY o.position""")
def naive_baseline(spark, d):
    o = base.outcome(spark, d)
    x, y = F.log(F.col("slot") + 1), F.col("ppg")
    # the residual sum of squares follows from the moments, so one aggregation is enough
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    return o.groupBy("position").agg(
        r6(F.regr_intercept(y, x)).alias("intercept"), r6(F.regr_slope(y, x)).alias("slope"),
        r6(F.sqrt(F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / F.count("*"))).alias("rmse"))


@query("exact_rank_index", """
    SELECT entity_id, position, row_number() OVER (PARTITION BY position ORDER BY slot, entity_id) - 1 AS board_pos FROM cohort""")
def exact_rank_index(spark, d):
    c = base.cohort(spark, d).select("entity_id", "position", "slot")
    return ranks.row_index_in_group(c, ["position"], "slot", "entity_id", "board_pos").select("entity_id", "position", "board_pos")
