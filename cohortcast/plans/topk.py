"""Top-k, boards and summaries."""

from pyspark.sql import functions as F

from cohortcast.functions.scores import conditional_value
from cohortcast.operators.grouped import attach, best_row, top_per_group
from cohortcast.operators.ranks import exact_quantiles
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query


@query("topn_ties", """
    SELECT position, cohort_year, entity_id, slot, rk FROM (
      SELECT *, CAST(rank() OVER (PARTITION BY position, cohort_year ORDER BY slot) AS INTEGER) AS rk FROM cohort) WHERE rk <= 10""")
def topn_ties(spark, d):
    c = base.cohort(spark, d).select("position", "cohort_year", "entity_id", "slot")
    return top_per_group(c, ["position", "cohort_year"], [F.col("slot").asc()], 10, ties=True, rank_col="rk")


@query("argmin_config", """
    SELECT name, entity_id, slot FROM (SELECT school_id AS name, entity_id, slot,
      row_number() OVER (PARTITION BY school_id ORDER BY slot, entity_id) AS rn FROM cohort) WHERE rn = 1""")
def argmin_config(spark, d):
    c = base.cohort(spark, d).select(F.col("school_id").alias("name"), "entity_id", "slot")
    return best_row(c, ["name"], [F.col("slot").asc(), F.col("entity_id").asc()])


@query("board_sort", """
    SELECT test_year, entity_id, position, round(exp_ppg_bucket, 6) AS exp_ppg, round(CASE WHEN p_made_it > 0 THEN exp_ppg_bucket / p_made_it END, 6) AS if_made_it
    FROM oos ORDER BY test_year, exp_ppg_bucket DESC NULLS LAST, entity_id""")
def board_sort(spark, d):
    return base.oos(spark, d).orderBy("test_year", F.col("exp_ppg_bucket").desc_nulls_last(), F.col("entity_id").asc()).select(
        "test_year", "entity_id", "position", r6(F.col("exp_ppg_bucket")).alias("exp_ppg"),
        r6(conditional_value(F.col("exp_ppg_bucket"), F.col("p_made_it"))).alias("if_made_it"))


@query("notable_residuals", """
    SELECT entity_id, position, round(exp_ppg - ppg, 6) AS residual FROM oos ORDER BY round(abs(exp_ppg - ppg), 9) DESC, entity_id LIMIT 20""")
def notable_residuals(spark, d):
    res = F.col("exp_ppg") - F.col("ppg")
    return base.oos(spark, d).orderBy(F.round(F.abs(res), 9).desc(), F.col("entity_id").asc()).limit(20).select(
        "entity_id", "position", r6(res).alias("residual"))


# the columns of a pivot are part of its result's schema; whatever is not among them is counted under `other`
POSITIONS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("pivot_counts", "SELECT cohort_year, " + ", ".join(
    f"count(*) FILTER (WHERE position = '{p}') AS {p.lower()}" for p in POSITIONS) + f""",
    count(*) FILTER (WHERE position IS NULL OR position NOT IN ({", ".join(f"'{p}'" for p in POSITIONS)})) AS other FROM cohort GROUP BY cohort_year""")
def pivot_counts(spark, d):
    named = F.when(F.col("position").isin(*POSITIONS), F.lower("position")).otherwise("other")
    columns = [*(p.lower() for p in POSITIONS), "other"]
    return base.cohort(spark, d).withColumn("column", named).groupBy("cohort_year").pivot("column", columns).count().fillna(0)


@query("class_depth", """
    SELECT test_year, position, count(*) FILTER (WHERE exp_ppg >= 3) AS n3, count(*) FILTER (WHERE exp_ppg >= 4) AS n4,
           count(*) FILTER (WHERE exp_ppg >= 5) AS n5, count(*) FILTER (WHERE exp_ppg >= 6) AS n6,
           max(CASE WHEN rn = 1 THEN name END) AS best_name, round(avg(exp_ppg) FILTER (WHERE rn <= 5), 6) AS top5_mean
    FROM (SELECT *, row_number() OVER (PARTITION BY test_year, position ORDER BY exp_ppg DESC, entity_id) AS rn FROM oos) GROUP BY ALL""")
def class_depth(spark, d):
    o = base.oos(spark, d).select("test_year", "position", "entity_id", "name", "exp_ppg")
    keys = ["test_year", "position"]
    counts = o.groupBy(*keys).agg(*[F.count_if(F.col("exp_ppg") >= t).alias(f"n{t}") for t in (3, 4, 5, 6)])
    top = top_per_group(o, keys, [F.col("exp_ppg").desc(), F.col("entity_id").asc()], 5, rank_col="rk").groupBy(*keys).agg(
        F.max(F.when(F.col("rk") == 1, F.col("name"))).alias("best_name"), r6(F.avg("exp_ppg")).alias("top5_mean"))
    return attach(counts, top, keys)


@query("class_summary", """
    WITH g AS (SELECT test_year, position, count(*) AS n, count(*) FILTER (WHERE exp_ppg >= 5) AS starters, round(median(exp_ppg), 6) AS median_ppg
               FROM oos GROUP BY ALL)
    SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY test_year), 6) AS mix FROM g""")
def class_summary(spark, d):
    o = base.oos(spark, d).select("test_year", "position", "exp_ppg")
    keys = ["test_year", "position"]
    g = o.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("exp_ppg") >= 5).alias("starters"))
    med = exact_quantiles(o, keys, "exp_ppg", [0.5], ["median_ppg"])
    both = attach(g, med, keys).withColumn("median_ppg", r6(F.col("median_ppg")))
    total = both.groupBy("test_year").agg(F.sum("n").alias("__n"))
    return attach(both, total, ["test_year"]).withColumn("mix", r6(F.col("n") / F.col("__n"))).drop("__n")


@query("coverage_report", """
    SELECT position, cohort_year, count(*) AS n, count(yards_final) AS matched, round(100.0 * count(yards_final) / count(*), 6) AS pct,
           round(avg(CASE WHEN forty IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS forty_rate
    FROM features GROUP BY ALL""")
def coverage_report(spark, d):
    n = F.count("yards_final")
    return base.features(spark, d).groupBy("position", "cohort_year").agg(
        F.count("*").alias("n"), n.alias("matched"), r6(F.lit(100.0) * n / F.count("*")).alias("pct"),
        r6(F.avg(F.col("forty").isNotNull().cast("double"))).alias("forty_rate"))
