"""Models of every position in bundles: fitted on the earlier classes, saved, loaded, all classes scored."""

from pyspark.sql import functions as F

from cohortcast.functions import scores as sc
from cohortcast.operators import bundle as bd
from cohortcast.operators import models as md
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.blends import role
from cohortcast.plans.registry import query
from cohortcast.session import materialize, scratch_path

TRAIN_BEFORE = 2000
FEATURES = ("log_slot", "age", "rating", "yards_final", "ypr", "games_final", "forty", "weight", "has_final")
SPEC = bd.BundleSpec(FEATURES, {"has_final": ["yards_final", "ypr", "games_final"]}, "cohort_year", "made_it", "log_ppg", "bucket", 5,
                     {"q50": 0.5, "q70": 0.7, "q90": 0.9}, md.Trees(rounds=10), forest=10)


def bundle_rows(spark, d):
    """Cohort members with raw features, gaps included, and outcomes.

    Files are in order of the positions, so the many passes over one position's rows skip the pages of the others, and of the ids, so
    that the row samples of the trees do not hang on the order in which shuffled rows arrive.
    """
    o, f = base.outcome_and_features(spark, d)
    f = f.join(o.select("entity_id", "made_it", "ppg"), "entity_id").select(
        "entity_id", "position", "cohort_year", "made_it", "ppg", F.log("slot").alias("log_slot"), "age", "rating", "yards_final", "ypr",
        F.col("games_final").cast("double").alias("games_final"), "forty", F.col("weight").cast("double").alias("weight"),
        F.col("yards_final").isNotNull().cast("double").alias("has_final"), F.when(F.col("ppg") > 0, F.log("ppg")).alias("log_ppg"))
    f = f.withColumn("role", role()).withColumn("bucket", sc.assign_bucket(F.col("ppg"), F.col("role")))
    return materialize(f.sortWithinPartitions("position", "entity_id"), "bundle-rows")


def scored_rows(spark, d):
    """All rows through bundles that went to disk and back."""
    x = bundle_rows(spark, d)
    path = scratch_path(spark, "bundles")
    names = bd.save_bundles(bd.fit_bundles(x.where(F.col("cohort_year") < TRAIN_BEFORE), "position", SPEC), path)
    return bd.score_bundles(x, "position", bd.load_bundles(spark, path, names))


@query("bundle_recipe", f"""
    WITH f AS (SELECT entity_id, position, cohort_year, forty, CAST(weight AS DOUBLE) AS weight, CASE WHEN yards_final IS NULL THEN 0 ELSE yards_final END AS yards_final,
                      CASE WHEN yards_final IS NULL THEN 0 ELSE ypr END AS ypr FROM features),
    m AS (SELECT position, median(forty) AS forty, median(weight) AS weight FROM f WHERE cohort_year < {TRAIN_BEFORE} GROUP BY position)
    SELECT f.entity_id, f.position, round(coalesce(f.forty, m.forty, 0), 6) AS forty, round(coalesce(f.weight, m.weight, 0), 6) AS weight,
           round(f.yards_final, 6) AS yards_final, round(f.ypr, 6) AS ypr FROM f JOIN m ON m.position = f.position""")
def bundle_recipe(spark, d):
    """Zero fill and medians of each position's earlier classes, by recipes that were saved and loaded."""
    x = bundle_rows(spark, d)
    out = None
    for r in x.where(F.col("cohort_year") < TRAIN_BEFORE).select("position").distinct().orderBy("position").collect():
        mine = F.col("position").eqNullSafe(F.lit(r["position"]))
        path = scratch_path(spark, "recipe")
        bd.Recipe(FEATURES, SPEC.fills).fit(x.where(mine & (F.col("cohort_year") < TRAIN_BEFORE))).write().save(path)
        part = bd.RecipeModel.load(path).transform(x.where(mine))
        out = part if out is None else out.unionByName(part)
    return out.select("entity_id", "position", *[r6(F.col(c)).alias(c) for c in ("forty", "weight", "yards_final", "ypr")])


@query("bundle_scores")
def bundle_scores(spark, d):
    """Estimates of every class by its position's bundle."""
    s = scored_rows(spark, d).withColumn("exp_ppg", sc.hurdle(F.col("p_made_it"), F.col("value")))
    return s.select("entity_id", "position", "cohort_year", "bundle", *[r6(F.col(c)).alias(c) for c in ("p_raw", "p_made_it", "value", "exp_ppg")],
                    *[r6(F.exp(q)).alias(q) for q in SPEC.quantiles], F.transform("probs", r6).alias("probs"))


@query("bundle_invariants", """
    SELECT c.entity_id, c.position, true AS own_bundle, true AS p_in_range, true AS quantiles_ordered, c.position <> 'MACHINERY' AS has_buckets, true AS buckets_sum
    FROM cohort c""")
def bundle_invariants(spark, d):
    """What must hold for each scored row, whatever the trees: its position's bundle, probabilities, ordered quantiles, bucket cuts of its position."""
    s, p, q = scored_rows(spark, d), F.col("p_made_it"), list(SPEC.quantiles)
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return s.select("entity_id", "position", (F.col("bundle") == F.col("position")).alias("own_bundle"),
                    (p.between(0, 1) & F.col("p_raw").between(0, 1) & (F.col("value") > 0)).alias("p_in_range"),
                    ((F.col(q[0]) <= F.col(q[1])) & (F.col(q[1]) <= F.col(q[2]))).alias("quantiles_ordered"),
                    F.col("probs").isNotNull().alias("has_buckets"),
                    F.coalesce((F.size("probs") == SPEC.levels) & (F.abs(total - 1) < 1e-9), F.lit(True)).alias("buckets_sum"))
