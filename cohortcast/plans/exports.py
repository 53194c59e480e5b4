"""Export families; documents are written and read back so that their content is compared."""

from pyspark.sql import functions as F

from cohortcast.operators import comps as cp
from cohortcast.operators import export as ex
from cohortcast.operators import ranks
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import scratch_path


@query("json_per_group", """
    SELECT test_year, entity_id, name, slot, round(exp_ppg, 4) AS exp_ppg, round(exp_ppg_bucket, 4) AS exp_ppg_bucket FROM oos""")
def json_per_group(spark, d):
    o = base.oos(spark, d).select("test_year", "entity_id", "name", "slot", F.round("exp_ppg", 4).alias("exp_ppg"),
                                  F.round("exp_ppg_bucket", 4).alias("exp_ppg_bucket"))
    path = scratch_path(spark, "documents")
    lines = ex.lines_per_group(o, "test_year", ["slot", "entity_id"], ["entity_id", "name", "slot", "exp_ppg", "exp_ppg_bucket"])
    ex.write_documents(lines, path, "test_year")
    back = spark.read.schema("value STRING, test_year INT").text(path)
    return back.select("test_year", F.from_json(
        "value", "entity_id BIGINT, name STRING, slot INT, exp_ppg DOUBLE, exp_ppg_bucket DOUBLE").alias("d")).select("test_year", "d.*")


@query("json_nested_children", """
    SELECT entity_id, CAST(rk AS INTEGER) AS slot_rank, comp_id, CAST(gap AS INTEGER) AS slot_gap FROM (
      SELECT q.entity_id, p.entity_id AS comp_id, abs(q.slot - p.slot) AS gap, row_number() OVER (PARTITION BY q.entity_id ORDER BY abs(q.slot - p.slot), p.entity_id) AS rk
      FROM cohort q JOIN cohort p ON p.position = q.position AND p.cohort_year < q.cohort_year) WHERE rk <= 3
    UNION ALL SELECT entity_id, NULL, NULL, NULL FROM cohort WHERE cohort_year = (SELECT min(cohort_year) FROM cohort)""")
def json_nested_children(spark, d):
    c = base.cohort(spark, d).select("entity_id", "position", "cohort_year", "slot")
    near = cp.nearest_by_slot(c, c, cp.cohort_years(c, "cohort_year"), cp.CompSpec({"all": ()}, covariance=False), 3)
    kids = c.withColumnRenamed("cohort_year", "cohort").join(near, ["position", "cohort", "slot"])
    path = scratch_path(spark, "children")
    ex.write_documents(ex.documents_with_children(c, kids, "entity_id", "slot_rank", ["comp_id", "slot_gap"]), path)
    back = ex.read_documents(spark, path, "entity_id BIGINT, children ARRAY<STRUCT<slot_rank: INT, comp_id: BIGINT, slot_gap: INT>>")
    return back.select("entity_id", F.explode_outer("children").alias("c")).select("entity_id", "c.*")


@query("entity_dossier", """
    WITH f AS (SELECT *, CASE WHEN yards_final IS NULL THEN NULL ELSE CAST(round_even(100 * (rank() OVER (PARTITION BY position ORDER BY yards_final NULLS LAST) - 1
                 + count(*) OVER (PARTITION BY position, yards_final)) / CAST(count(yards_final) OVER (PARTITION BY position) AS DOUBLE), 0) AS INTEGER) END AS yards_pct FROM features),
    h AS (SELECT entity_id, count(*) AS n_seasons, max(season) AS last_season, CAST(max_by(cents, season) AS BIGINT) AS last_cents FROM panel GROUP BY 1)
    SELECT f.entity_id, f.position, round(f.yards_final, 4) AS yards_final, f.yards_pct, CAST(f.weight AS VARCHAR) AS raw_weight,
           CAST(h.n_seasons AS INTEGER) AS n_seasons, h.last_season, h.last_cents
    FROM f LEFT JOIN h ON h.entity_id = f.entity_id""")
def entity_dossier(spark, d):
    f = base.features(spark, d).select("entity_id", "name", "position", "cohort_year", "slot", "yards_final", "weight", "forty")
    f = ranks.cume_dist_in_group(f, ["position"], "yards_final", "__p", 100)
    block = ex.feature_block({"yards_final": (F.round("yards_final", 4), F.bround("__p"), "Volume in the final season"),
                              "forty": (F.col("forty"), F.lit(None).cast("int"), "Sprint time")})
    raw = ex.key_values(["name", "slot", "weight", "forty"], skip=["forty"])
    docs = ex.dossiers(f, base.panel(spark, d), "entity_id", "season", ["games", "cents"], ["entity_id", "name", "position"], block, raw)
    path = scratch_path(spark, "dossiers")
    ex.write_documents(docs, path)
    back = ex.read_documents(spark, path, """summary STRUCT<entity_id: BIGINT, name: STRING, position: STRING>,
        features ARRAY<STRUCT<feature: STRING, value: DOUBLE, percentile: INT, description: STRING>>,
        trajectory ARRAY<STRUCT<season: INT, games: BIGINT, cents: BIGINT>>, raw ARRAY<STRUCT<field: STRING, value: STRING>>""")
    first = F.filter("features", lambda x: x["feature"] == "yards_final")[0]
    weight = F.filter("raw", lambda x: x["field"] == "weight")[0]["value"]
    last = F.element_at("trajectory", -1)
    return back.select("summary.entity_id", "summary.position", first["value"].alias("yards_final"), first["percentile"].alias("yards_pct"),
                       weight.alias("raw_weight"), F.when(F.col("trajectory").isNotNull(), F.size("trajectory")).alias("n_seasons"),
                       last["season"].alias("last_season"), last["cents"].alias("last_cents"))


@query("meta_summary", """
    SELECT array_to_string(list_sort(list(DISTINCT cohort_year)), ',') AS years, array_to_string(list_sort(list(DISTINCT position)), ',') AS positions, count(*) AS total FROM cohort""")
def meta_summary(spark, d):
    return ex.index_document(base.cohort(spark, d), "cohort_year", "position").select(
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join("positions", ",").alias("positions"), "total")
