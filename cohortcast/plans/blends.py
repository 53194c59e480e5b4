"""Combiners, blends and sweeps on out-of-sample rows."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.functions import scores as sc
from cohortcast.operators import evaluate as ev
from cohortcast.operators.grouped import add_group_stats
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import materialize

# positions of the test tables standing for the football ones
ROLE = {"AUTOMOBILE": "WR", "BUILDING": "RB", "FURNITURE": "QB", "HOUSEHOLD": "TE"}
ROLE_SQL = "CASE position " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE.items()) + " ELSE 'K' END"


def role():
    out = None
    for k, v in ROLE.items():
        out = F.when(F.col("position") == k, v) if out is None else out.when(F.col("position") == k, v)
    return out.otherwise("K")


GRID_SQL = f"""
    SELECT 'identity' AS transform, 1.0::DOUBLE AS alpha, 0.0::DOUBLE AS beta, 1.0::DOUBLE AS gamma
    UNION ALL SELECT 'isotonic', 1, 0, 1
    UNION ALL SELECT t, round(a * 0.05, 2), 0, 1 FROM range(21) r(a), (VALUES ('shrink'), ('iso_shrink')) v(t)
    UNION ALL SELECT t, round(a * 0.05, 2), round(b * 0.025, 3), 1 FROM range(21) r(a), range(-6, 7) s(b), (VALUES ('linear'), ('iso_linear')) v(t)
    UNION ALL SELECT 'power_shrink', round(a * 0.05, 2), 0, g FROM range(21) r(a), (VALUES {', '.join(f'({g})' for g in presets.GAMMA_GRID)}) v(g)"""

SWEEP_SQL = f"""
    SELECT o.position, o.test_year, g.transform, g.alpha, g.beta, g.gamma, count(*) AS n, sum(abs(ppg - greatest(prod_pred * CASE transform
        WHEN 'identity' THEN p_made_it WHEN 'isotonic' THEN p_iso
        WHEN 'shrink' THEN least(1, greatest(0, alpha * p_made_it + (1 - alpha) * base_rate))
        WHEN 'linear' THEN least(1, greatest(0, alpha * p_made_it + beta))
        WHEN 'power_shrink' THEN least(1, greatest(0, alpha * pow(p_made_it, gamma) + (1 - alpha) * base_rate))
        WHEN 'iso_shrink' THEN least(1, greatest(0, alpha * p_iso + (1 - alpha) * base_rate))
        WHEN 'iso_linear' THEN least(1, greatest(0, alpha * p_iso + beta)) END, 0))) AS err
    FROM (SELECT *, avg(made_it) OVER (PARTITION BY position) AS base_rate FROM oos) o, ({GRID_SQL}) g GROUP BY ALL"""


def combiner_input(spark, d):
    o = base.oos(spark, d).select("position", "test_year", "made_it", "p_made_it", "p_iso", "prod_pred", "ppg")
    return add_group_stats(materialize(o, "combiner-input"), ["position"], F.avg("made_it").alias("base_rate"))


@query("combiner_sweep", f"""
    SELECT position, transform, alpha, beta, gamma, CAST(sum(n) AS BIGINT) AS n, round(sum(err) / sum(n), 6) AS mae FROM ({SWEEP_SQL}) GROUP BY ALL""")
def combiner_sweep(spark, d):
    e = ev.combiner_errors(combiner_input(spark, d), ["position"])
    return e.select("position", *ev.SETTING, "n", r6(F.col("err") / F.col("n")).alias("mae"))


@query("lofo_select", f"""
    WITH e AS ({SWEEP_SQL}),
    t AS (SELECT *, round((sum(err) OVER w - err) / (sum(n) OVER w - n), 9) AS train_mae FROM e WINDOW w AS (PARTITION BY position, transform, alpha, beta, gamma)),
    b AS (SELECT *, row_number() OVER (PARTITION BY position, test_year ORDER BY train_mae, transform, alpha, beta, gamma) AS rn FROM t)
    SELECT position, test_year, transform, alpha, beta, gamma, n, round(train_mae, 6) AS train_mae, round(err / n, 6) AS test_mae FROM b WHERE rn = 1""")
def lofo_select(spark, d):
    e = ev.combiner_errors(combiner_input(spark, d), ["position", "test_year"])
    out = ev.leave_one_fold_out(e, ["position"], "test_year")
    return out.withColumns({"train_mae": r6(F.col("train_mae")), "test_mae": r6(F.col("test_mae"))})


@query("hurdle_score", f"""
    WITH x AS (SELECT *, {ROLE_SQL} AS role FROM oos)
    SELECT entity_id, role, round(CASE role WHEN 'RB' THEN least(1, greatest(0, p_iso - 0.05)) WHEN 'TE' THEN p_made_it WHEN 'K' THEN p_made_it
             ELSE least(1, greatest(0, 0.85 * sqrt(p_made_it))) END, 6) AS p_eff,
           round(greatest(0, (CASE role WHEN 'RB' THEN least(1, greatest(0, p_iso - 0.05)) WHEN 'TE' THEN p_made_it WHEN 'K' THEN p_made_it
             ELSE least(1, greatest(0, 0.85 * sqrt(p_made_it))) END) * exp(ln(prod_pred))), 6) AS exp_ppg FROM x""")
def hurdle_score(spark, d):
    x = base.oos(spark, d).withColumn("role", role())
    p = sc.deployed_combiner(F.col("role"), F.col("p_made_it"), F.col("p_iso"))
    return x.select("entity_id", "role", r6(p).alias("p_eff"), r6(sc.hurdle(p, F.log("prod_pred"))).alias("exp_ppg"))


@query("geo_ensemble", """
    SELECT entity_id, bucket, round(sqrt(p * q) / sum(sqrt(p * q)) OVER (PARTITION BY entity_id), 6) AS p FROM bucket_probs""")
def geo_ensemble(spark, d):
    e = base.bucket_probs(spark, d).select("entity_id", sc.geometric_ensemble(F.col("p"), F.col("q")).alias("e"))
    return e.select("entity_id", F.posexplode("e").alias("bucket", "p")).withColumn("p", r6(F.col("p")))


def cuts_sql(value, table):
    arms = []
    for r, (z, *rest) in table.items():
        inner = f"WHEN {value} <= {z} THEN 0 " + " ".join(f"WHEN {value} < {c} THEN {i}" for i, c in enumerate(rest, 1))
        arms.append(f"WHEN '{r}' THEN CASE {inner} WHEN {value} IS NOT NULL THEN {len(rest) + 1} END")
    return f"CASE role {' '.join(arms)} END"


@query("bucket_assign", f"""
    SELECT entity_id, role, CAST({cuts_sql('ppg', presets.BUCKET_CUTS)} AS INTEGER) AS bucket FROM (SELECT *, {ROLE_SQL} AS role FROM outcome)""")
def bucket_assign(spark, d):
    x = base.outcome(spark, d).withColumn("role", role())
    return x.select("entity_id", "role", sc.assign_bucket(F.col("ppg"), F.col("role")).alias("bucket"))


MID_SQL = "CASE role " + " ".join(
    f"WHEN '{r}' THEN CASE bucket " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(ms)) + " END" for r, ms in presets.BUCKET_MIDPOINTS.items()) + " END"


@query("bucket_expectation", f"""
    SELECT entity_id, role, round(sum(p * {MID_SQL}), 6) AS exp_ppg, CAST(arg_max(bucket, p) AS INTEGER) AS top1
    FROM (SELECT *, {ROLE_SQL} AS role FROM bucket_probs) GROUP BY ALL""")
def bucket_expectation(spark, d):
    x = base.bucket_probs(spark, d).withColumn("role", role())
    top1 = F.array_position("p", F.array_max("p")).cast("int") - 1
    return x.select("entity_id", "role", r6(sc.expectation(F.col("p"), sc.midpoints_of(F.col("role")))).alias("exp_ppg"), top1.alias("top1"))


@query("final_blend", f"""
    WITH x AS (SELECT *, {ROLE_SQL} AS role FROM oos),
    y AS (SELECT *, CASE WHEN exp_ppg_bucket IS NULL THEN exp_ppg WHEN role = 'WR' THEN 0.30 * exp_ppg + 0.70 * exp_ppg_bucket
                    WHEN role = 'RB' THEN 0.20 * exp_ppg + 0.80 * exp_ppg_bucket ELSE exp_ppg END AS e1 FROM x)
    SELECT entity_id, role, round(e1, 6) AS model_ppg, round(CASE WHEN comp_ppg IS NULL THEN e1 WHEN role = 'WR' THEN 0.60 * e1 + 0.40 * comp_ppg
             WHEN role = 'RB' THEN 0.35 * e1 + 0.65 * comp_ppg WHEN role = 'QB' THEN 0.5 * e1 + 0.5 * comp_ppg
             WHEN role = 'TE' THEN 0.3 * e1 + 0.7 * comp_ppg ELSE e1 END, 6) AS final_ppg FROM y""")
def final_blend(spark, d):
    x = base.oos(spark, d).withColumn("role", role())
    model = sc.blend(F.col("role"), F.col("exp_ppg"), F.col("exp_ppg_bucket"), presets.HURDLE_WEIGHT)
    y = x.withColumn("e1", model)
    return y.select("entity_id", "role", r6(F.col("e1")).alias("model_ppg"),
                    r6(sc.blend(F.col("role"), F.col("e1"), F.col("comp_ppg"), presets.MODEL_WEIGHT)).alias("final_ppg"))


BLEND_SQL = """
    WITH x AS (SELECT position, ppg, exp_ppg, exp_ppg_bucket FROM oos WHERE exp_ppg_bucket IS NOT NULL),
    g AS (SELECT position, ppg, exp_ppg, exp_ppg_bucket FROM x UNION ALL SELECT 'ALL', ppg, exp_ppg, exp_ppg_bucket FROM x)
    SELECT position, count(*) AS n, i / 20.0 AS weight, avg(abs(ppg - ((i / 20.0) * exp_ppg_bucket + (1 - i / 20.0) * exp_ppg))) AS mae
    FROM g, range(21) r(i) GROUP BY position, i"""


@query("blend_sweep", f"SELECT position, n, CAST(weight AS DOUBLE) AS weight, round(mae, 6) AS mae FROM ({BLEND_SQL})")
def blend_sweep(spark, d):
    return ev.blend_errors(base.oos(spark, d), ["position"], "ppg", "exp_ppg", "exp_ppg_bucket").withColumn("mae", r6(F.col("mae")))


@query("blend_best", f"""
    SELECT position, CAST(weight AS DOUBLE) AS weight, round(mae, 6) AS mae FROM (
      SELECT *, row_number() OVER (PARTITION BY position ORDER BY round(mae, 9), weight) AS rn FROM ({BLEND_SQL})) WHERE rn = 1""")
def blend_best(spark, d):
    e = ev.blend_errors(base.oos(spark, d), ["position"], "ppg", "exp_ppg", "exp_ppg_bucket")
    return ev.best_setting(e, ["position"], "mae", ["weight"]).select("position", "weight", r6(F.col("mae")).alias("mae"))


@query("before_after", """
    SELECT position, CASE WHEN round <= 2 THEN CAST(round AS VARCHAR) ELSE '3+' END AS round_group, count(*) AS n,
           round(avg(abs(ppg - exp_ppg)), 6) AS mae_before, round(avg(abs(ppg - coalesce(exp_ppg_bucket, exp_ppg))), 6) AS mae_after,
           round(avg(abs(ppg - coalesce(exp_ppg_bucket, exp_ppg))) - avg(abs(ppg - exp_ppg)), 6) AS delta FROM oos GROUP BY ALL""")
def before_after(spark, d):
    group = F.when(F.col("round") <= 2, F.col("round").cast("string")).otherwise("3+")
    b = F.avg(F.abs(F.col("ppg") - F.col("exp_ppg")))
    a = F.avg(F.abs(F.col("ppg") - F.coalesce("exp_ppg_bucket", "exp_ppg")))
    return base.oos(spark, d).groupBy("position", group.alias("round_group")).agg(
        F.count("*").alias("n"), r6(b).alias("mae_before"), r6(a).alias("mae_after"), r6(a - b).alias("delta"))


@query("inner_suffix_join", """
    SELECT h.entity_id, h.position, round(h.exp_ppg, 6) AS exp_ppg_hurdle, round(b.exp_ppg, 6) AS exp_ppg_bucket, round(h.ppg, 6) AS ppg
    FROM oos h JOIN (SELECT entity_id, exp_ppg_bucket AS exp_ppg FROM oos WHERE exp_ppg_bucket IS NOT NULL) b ON b.entity_id = h.entity_id""")
def inner_suffix_join(spark, d):
    """Two prediction tables side by side, clashing columns told apart by suffix."""
    from cohortcast.operators.match import inner_with_suffixes
    o = base.oos(spark, d)
    hurdle = o.select("entity_id", "position", "ppg", "exp_ppg")
    bucket = o.where("exp_ppg_bucket is not null").select("entity_id", F.col("exp_ppg_bucket").alias("exp_ppg"))
    out = inner_with_suffixes(hurdle, bucket, ["entity_id"], ("_hurdle", "_bucket"))
    return out.withColumns({c: r6(F.col(c)) for c in ("exp_ppg_hurdle", "exp_ppg_bucket", "ppg")})
