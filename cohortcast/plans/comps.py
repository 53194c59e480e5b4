"""Comparable-search families."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators import comps as cp
from cohortcast.operators.grouped import attach
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import materialize, scratch_path

EUCLID = cp.CompSpec({"all": ("yards_final", "ypr", "forty", "weight")}, covariance=False)
MAHAL = cp.CompSpec({"production": ("yards_final", "ypr"), "measurables": ("forty", "weight")}, presets.COMP_WEIGHTS)
LABELS = {"yards_final": "Volume", "ypr": "Efficiency", "forty": "Speed", "weight": "Size"}


def comp_base(spark, d):
    """Feature rows with their outcome, written once because the search reads them several times."""
    o, f = base.outcome_and_features(spark, d)
    f = f.join(o.select("entity_id", "ppg", "made_it"), "entity_id")
    return materialize(f.select("entity_id", "name", "position", "cohort_year", "slot", "yards_final", "ypr", "forty", "weight",
                                "ppg", "made_it", F.col("ppg").alias("comp_ppg"), F.col("name").alias("comp_name")), "comp-base")


def euclid(spark, d, spec=EUCLID):
    b = comp_base(spark, d)
    params = cp.search_params(b, cp.cohort_years(b, "cohort_year"), spec)
    return b, params, cp.nearest_comps(b, b, spec, ["comp_ppg", "comp_name"], params)


@query("past_pool", """
    SELECT q.entity_id, count(p.entity_id) AS n_pool, round(avg(p.ppg), 6) AS pool_ppg, round(avg(CASE WHEN p.ppg < 5 THEN 1.0 ELSE 0.0 END), 6) AS pool_bust
    FROM outcome q LEFT JOIN outcome p ON p.position = q.position AND p.cohort_year < q.cohort_year
    WHERE q.cohort_year > (SELECT min(cohort_year) FROM cohort) GROUP BY q.entity_id""")
def past_pool(spark, d):
    from pyspark.sql import Window
    o = base.outcome(spark, d).select("entity_id", "position", "cohort_year", "ppg")
    per_year = o.groupBy("position", "cohort_year").agg(
        F.count("*").alias("n"), F.sum("ppg").alias("s"), F.count_if(F.col("ppg") < presets.COMP_BUST_BELOW).alias("b"))
    before = Window.partitionBy("position").orderBy("cohort_year").rowsBetween(Window.unboundedPreceding, -1)
    past = per_year.select("position", "cohort_year", *[F.sum(c).over(before).alias(c) for c in ("n", "s", "b")]).where("n > 0")
    return attach(o, past, ["position", "cohort_year"], how="inner").select(
        "entity_id", F.col("n").alias("n_pool"), r6(F.col("s") / F.col("n")).alias("pool_ppg"), r6(F.col("b") / F.col("n")).alias("pool_bust"))


@query("band_join_topk", """
    SELECT entity_id, comp_id, gap AS slot_gap, CAST(rk AS INTEGER) AS slot_rank FROM (
      SELECT q.entity_id, p.entity_id AS comp_id, abs(q.slot - p.slot) AS gap,
             row_number() OVER (PARTITION BY q.entity_id ORDER BY abs(q.slot - p.slot), p.entity_id) AS rk
      FROM cohort q JOIN cohort p ON p.position = q.position AND p.cohort_year < q.cohort_year) WHERE rk <= 5""")
def band_join_topk(spark, d):
    c = base.cohort(spark, d).select("entity_id", "position", "cohort_year", "slot")
    near = cp.nearest_by_slot(c, c, cp.cohort_years(c, "cohort_year"), EUCLID, 5)
    return c.withColumnRenamed("cohort_year", "cohort").join(near, ["position", "cohort", "slot"]).select(
        "entity_id", "comp_id", "slot_gap", "slot_rank")


def slot_pairs(spark, d, spec):
    b = comp_base(spark, d)
    cohorts = cp.cohort_years(b, "cohort_year")
    params = cp.search_params(b, cohorts, spec)
    asked = b.join(params.where(F.col("n_pool") >= spec.min_pool).select("position", F.col("cohort").alias("cohort_year")),
                   ["position", "cohort_year"], "left_semi")
    near = cp.nearest_by_slot(asked, b, cohorts, spec, 6)
    pairs = asked.select("entity_id", "position", F.col("cohort_year").alias("cohort"), "slot").join(near, ["position", "cohort", "slot"])
    out = cp.distances_of(pairs, asked, b, params, spec, ["comp_ppg"])
    return out.select("entity_id", "comp_id", r6(F.col("distance")).alias("distance"))


PAIRS_SQL = """
    SELECT entity_id, comp_id, round(distance, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY gap, comp_id) AS rk FROM {0}) WHERE rk <= 6"""


@query("scaled_euclid_pairs", PAIRS_SQL.format("euclid_pairs"))
def scaled_euclid_pairs(spark, d):
    return slot_pairs(spark, d, EUCLID)


@query("mahalanobis_pairs", PAIRS_SQL.format("mahal_pairs"))
def mahalanobis_pairs(spark, d):
    return slot_pairs(spark, d, MAHAL)


@query("knn_comps", """
    SELECT entity_id, comp_rank, comp_id, round(distance, 6) AS distance, round(exp(-distance), 6) AS similarity, round(comp_ppg, 6) AS comp_ppg FROM euclid_comps""")
def knn_comps(spark, d):
    _, _, found = euclid(spark, d)
    return found.select("entity_id", "comp_rank", "comp_id", r6(F.col("distance")).alias("distance"),
                        r6(cp.similarity(1.0)).alias("similarity"), r6(F.col("comp_ppg")).alias("comp_ppg"))


@query("knn_mahalanobis", """
    SELECT entity_id, comp_rank, comp_id, round(distance, 6) AS distance, round(comp_ppg, 6) AS comp_ppg FROM mahal_comps""")
def knn_mahalanobis(spark, d):
    b = comp_base(spark, d)
    found = cp.nearest_comps(b, b, MAHAL, ["comp_ppg"])
    return found.select("entity_id", "comp_rank", "comp_id", r6(F.col("distance")).alias("distance"), r6(F.col("comp_ppg")).alias("comp_ppg"))


@query("comps_new_class", """
    SELECT entity_id, comp_rank, comp_id, round(distance, 6) AS distance, round(comp_ppg, 6) AS comp_ppg FROM euclid_comps
    WHERE cohort_year = (SELECT max(cohort_year) FROM cohort)""")
def comps_new_class(spark, d):
    """The newest class, which the pool lacks, against a stored index of the classes before it."""
    b = comp_base(spark, d)
    newest = b.agg(F.max("cohort_year")).scalar()
    pool = materialize(b.where(F.col("cohort_year") < newest), "comp-pool")
    path = scratch_path(spark, "comp-index")
    cp.index_of(pool, EUCLID, ["comp_ppg"]).save(path)
    index = cp.load_index(spark, path)
    found = cp.nearest_comps(materialize(b.where(F.col("cohort_year") == newest), "comp-new"), index.pool, EUCLID, ["comp_ppg"], index=index)
    return found.select("entity_id", "comp_rank", "comp_id", r6(F.col("distance")).alias("distance"), r6(F.col("comp_ppg")).alias("comp_ppg"))


@query("comp_features", """
    SELECT c.entity_id, coalesce(n.n_pool, 0) AS n_pool_used, round(w, 6) AS comp_weighted_ppg, round(b, 6) AS comp_bust_rate, round(m, 6) AS comp_median_ppg
    FROM cohort c LEFT JOIN comp_pool n ON n.position = c.position AND n.cohort = c.cohort_year
    LEFT JOIN (SELECT entity_id, sum(exp(-distance) * comp_ppg) / nullif(sum(exp(-distance)), 0) AS w,
                      avg(CASE WHEN comp_ppg < 5 THEN 1.0 ELSE 0.0 END) AS b, median(comp_ppg) AS m FROM euclid_comps GROUP BY 1) x ON x.entity_id = c.entity_id""")
def comp_features(spark, d):
    b, params, found = euclid(spark, d)
    out = cp.comp_features(b, found, params, EUCLID, "comp_ppg")
    return out.select("entity_id", "n_pool_used", *[r6(F.col(c)).alias(c) for c in ("comp_weighted_ppg", "comp_bust_rate", "comp_median_ppg")])


@query("comp_reasons", """
    WITH g AS (
      SELECT e.entity_id, e.comp_id, e.comp_rank, i, label, round(gap, 9) AS gap FROM euclid_comps e
      JOIN comp_wide w ON w.position = e.position AND w.cohort = e.cohort_year,
      LATERAL (VALUES (0, 'Volume', abs(d0) / s0), (1, 'Efficiency', abs(d1) / s1), (2, 'Speed', abs(d2) / s2), (3, 'Size', abs(d3) / s3)) t(i, label, gap)),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, comp_id ORDER BY gap, i) AS rn FROM g WHERE gap IS NOT NULL)
    SELECT e.entity_id, e.comp_id, e.comp_rank, coalesce(x.reasons, '') AS reasons FROM euclid_comps e
    LEFT JOIN (SELECT entity_id, comp_id, string_agg(label, ', ' ORDER BY rn) AS reasons FROM r WHERE rn <= 3 GROUP BY ALL) x
    ON x.entity_id = e.entity_id AND x.comp_id = e.comp_id""")
def comp_reasons(spark, d):
    b, params, found = euclid(spark, d)
    return cp.comp_reasons(found, b, b, params, EUCLID, LABELS)


@query("comp_summary", """
    SELECT entity_id, count(*) AS n_comps, round(sum(exp(-distance) * comp_ppg) / nullif(sum(exp(-distance)), 0), 6) AS weighted_ppg,
           round(median(comp_ppg), 6) AS median_ppg, round(avg(CASE WHEN comp_ppg < 5 THEN 1.0 ELSE 0.0 END), 6) AS bust_rate,
           round(avg(CASE WHEN comp_ppg >= 8 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, string_agg(comp_name, ', ' ORDER BY comp_rank) AS names
    FROM euclid_comps GROUP BY entity_id""")
def comp_summary(spark, d):
    _, _, found = euclid(spark, d)
    out = cp.comp_summary(found, "entity_id", "comp_ppg", "comp_name")
    return out.select("entity_id", "n_comps", *[r6(F.col(c)).alias(c) for c in ("weighted_ppg", "median_ppg", "bust_rate", "hit_rate")], "names")
