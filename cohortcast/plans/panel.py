"""Panel families: targets, shrinkage, thresholds, curves, opportunity."""

from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.operators import panel as pn
from cohortcast.operators.grouped import add_group_stats, attach, collapse_duplicates
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query

AGES = presets.AGE_CURVE_RANGE


@query("outcome_target", """
    SELECT entity_id, position, cohort_year, slot, round(raw_ppg, 6) AS raw_ppg, round(weighted_ppg, 6) AS weighted_ppg,
           round(shrunk_ppg, 6) AS shrunk_ppg, top2_games, n_qual, made_it, round(ppg, 6) AS ppg FROM outcome""")
def outcome_target(spark, d):
    o = base.outcome(spark, d)
    return o.select("entity_id", "position", "cohort_year", "slot", *[r6(F.col(c)).alias(c) for c in ("raw_ppg", "weighted_ppg", "shrunk_ppg")],
                    "top2_games", "n_qual", "made_it", r6(F.col("ppg")).alias("ppg"))


@query("partial_outcome", """
    WITH q AS (SELECT * FROM outcome_seasons WHERE season_num <= 2 AND games >= 1),
    t AS (SELECT entity_id, sum(season_ppg * games) / sum(games) AS w, count(*) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY season_ppg DESC, season_num) AS rn FROM q) WHERE rn <= 2 GROUP BY 1)
    SELECT c.entity_id, c.cohort_year, round(coalesce(t.w, 0), 6) AS actual_ppg, coalesce(t.n, 0) AS n_qual
    FROM cohort c LEFT JOIN t USING (entity_id) WHERE c.cohort_year >= 1999""")
def partial_outcome(spark, d):
    s = base.outcome_seasons(spark, d).where("cohort_year >= 1999 AND season_num <= 2 AND games >= 1")
    best = pn.weighted_best(s, ["entity_id"], "season_ppg", "games", "season_num", 2)
    c = base.cohort(spark, d).where("cohort_year >= 1999").select("entity_id", "cohort_year")
    return c.join(best, "entity_id", "left").select(
        "entity_id", "cohort_year", r6(F.coalesce("weighted_ppg", F.lit(0.0))).alias("actual_ppg"), F.coalesce("n_qual", F.lit(0)).alias("n_qual"))


@query("weighted_top2", """
    SELECT entity_id, round(raw_ppg, 6) AS raw_ppg, round(weighted_ppg, 6) AS weighted_ppg, top2_games, n_qual FROM production""")
def weighted_top2(spark, d):
    return base.production(spark, d).select("entity_id", r6(F.col("raw_ppg")).alias("raw_ppg"),
                                            r6(F.col("weighted_ppg")).alias("weighted_ppg"), "top2_games", "n_qual")


@query("eb_shrinkage", """
    SELECT entity_id, position, round(weighted_ppg, 6) AS weighted_ppg, round(shrunk_ppg, 6) AS shrunk_ppg FROM shrunk""")
def eb_shrinkage(spark, d):
    return base.shrunk(spark, d).select("entity_id", "position", r6(F.col("weighted_ppg")).alias("weighted_ppg"), r6(F.col("shrunk_ppg")).alias("shrunk_ppg"))


@query("collapse_max", """
    SELECT entity_id, season, max(qty) AS qty, max(lines) AS lines, min(team) AS first_team FROM team_panel GROUP BY ALL""")
def collapse_max(spark, d):
    return collapse_duplicates(base.team_panel(spark, d).withColumn("first_team", F.col("team")), ["entity_id", "season"],
                               ["qty", "lines"], ["first_team"], F.col("team"))


SHARES_SQL = """SELECT entity_id, season, max(CAST(qty AS DOUBLE) / tot) AS share, CAST(sum(qty) AS BIGINT) AS qty
                FROM (SELECT *, sum(qty) OVER (PARTITION BY team, season) AS tot FROM team_panel) GROUP BY ALL"""


def season_shares(spark, d):
    tp = add_group_stats(base.team_panel(spark, d), ["team", "season"], F.sum("qty").alias("tot"))
    return tp.groupBy("entity_id", "season").agg(F.max(F.col("qty") / F.col("tot")).alias("share"), F.sum("qty").alias("qty"))


@query("first_threshold", f"""
    WITH s AS ({SHARES_SQL}),
    a AS (SELECT m.entity_id, s.share, s.qty, m.age - (m.cohort_year - s.season) AS age_in_season
          FROM measures m JOIN s ON s.entity_id = m.entity_id AND s.season < m.cohort_year)
    SELECT entity_id, count(*) AS n_seasons, round(min(CASE WHEN share >= 0.02 THEN age_in_season END), 6) AS breakout_age,
           round(max(CASE WHEN age_in_season < 22 THEN share END), 6) AS peak_share,
           CAST(max(CASE WHEN age_in_season < 21 THEN qty END) AS BIGINT) AS peak_volume,
           CAST(sum(CASE WHEN share >= 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_dominant,
           CASE WHEN min(CASE WHEN share >= 0.02 THEN age_in_season END) IS NULL THEN 0 ELSE 1 END AS has_breakout,
           round(coalesce(min(CASE WHEN share >= 0.02 THEN age_in_season END), 23), 6) AS breakout_age_imputed
    FROM a WHERE age_in_season BETWEEN 17 AND 25 GROUP BY entity_id""")
def first_threshold(spark, d):
    m = base.measures(spark, d).select("entity_id", "cohort_year", "age")
    a = (season_shares(spark, d).join(m, "entity_id").where(F.col("season") < F.col("cohort_year"))
         .withColumn("age_in_season", F.col("age") - (F.col("cohort_year") - F.col("season"))))
    out = pn.first_threshold(a, ["entity_id"], "age_in_season", "share", "qty", 0.02, 22, 21, 23.0, (17, 25))
    return out.withColumns({c: r6(F.col(c)) for c in ("breakout_age", "peak_share", "breakout_age_imputed")})


CURVE_SQL = f"""
    SELECT least(24, greatest(18, CAST(round_even(age, 0) AS INTEGER))) AS age_bucket, count(*) AS n, avg(best) AS mean, stddev_samp(best) AS sd
    FROM (SELECT m.entity_id, m.age, max(s.share) AS best FROM measures m JOIN ({SHARES_SQL}) s
          ON s.entity_id = m.entity_id AND s.season < m.cohort_year GROUP BY ALL) GROUP BY 1"""


def curve(spark, d):
    m = base.measures(spark, d).select("entity_id", "cohort_year", "age")
    s = season_shares(spark, d).join(m, "entity_id").where(F.col("season") < F.col("cohort_year"))
    return pn.age_curve(s, ["entity_id"], "age", "share", AGES)


@query("age_curve", f"SELECT age_bucket, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM ({CURVE_SQL})")
def age_curve(spark, d):
    return curve(spark, d).withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


@query("age_adjusted", f"""
    WITH k AS ({CURVE_SQL}), f AS (SELECT m.entity_id, m.age, s.share FROM measures m LEFT JOIN ({SHARES_SQL}) s
                                   ON s.entity_id = m.entity_id AND s.season = m.cohort_year - 1)
    SELECT f.entity_id, round(f.share - k.mean, 6) AS age_resid, round(CASE WHEN k.sd > 0 THEN (f.share - k.mean) / k.sd END, 6) AS age_z
    FROM f LEFT JOIN k ON k.age_bucket = least(24, greatest(18, CAST(round_even(f.age, 0) AS INTEGER)))""")
def age_adjusted(spark, d):
    s = season_shares(spark, d).select("entity_id", (F.col("season") + 1).alias("cohort_year"), "share")
    f = base.measures(spark, d).select("entity_id", "cohort_year", "age").join(s, ["entity_id", "cohort_year"], "left")
    out = pn.curve_residual(f, curve(spark, d), "age", "share", AGES)
    return out.select("entity_id", r6(F.col("age_resid")).alias("age_resid"), r6(F.col("age_z")).alias("age_z"))


TRANS_SQL = """SELECT r.*, coalesce(n.team = r.team, false) AS stayed FROM roster r
               LEFT JOIN roster n ON n.entity_id = r.entity_id AND n.season = r.season + 1"""


def transitions(spark, d):
    return pn.season_transitions(base.roster(spark, d), "entity_id", "season", "team")


@query("vacated_share", f"""
    WITH t AS ({TRANS_SQL}), tot AS (SELECT team, season, CAST(sum(qty) AS BIGINT) AS team_qty FROM team_panel GROUP BY ALL),
    l AS (SELECT team, season, CAST(sum(CASE WHEN NOT stayed THEN qty ELSE 0 END) AS BIGINT) AS vacated,
                 CAST(sum(CASE WHEN stayed AND qty >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_returning FROM t GROUP BY ALL)
    SELECT l.team, l.season, vacated, n_returning, team_qty, round(CASE WHEN team_qty > 0 THEN CAST(vacated AS DOUBLE) / team_qty END, 6) AS vacated_share
    FROM l LEFT JOIN tot ON tot.team = l.team AND tot.season = l.season""")
def vacated_share(spark, d):
    totals = base.team_panel(spark, d).groupBy("team", "season").agg(F.sum("qty").alias("team_qty"))
    out = pn.vacated_share(transitions(spark, d), ["team", "season"], "qty", 100, totals, "team_qty")
    return out.select("team", "season", "vacated", "n_returning", "team_qty", r6(F.col("vacated_share")).alias("vacated_share"))


@query("top_incumbent", f"""
    WITH t AS ({TRANS_SQL})
    SELECT team, season, entity_id, qty, round(datediff('day', DATE '1970-01-01' + CAST(entity_id % 3000 AS INTEGER), make_date(season + 1, 9, 1)) / 365.25, 6) AS age
    FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY qty DESC, entity_id) AS rn FROM t WHERE stayed) WHERE rn = 1""")
def top_incumbent(spark, d):
    top = pn.top_incumbent(transitions(spark, d), ["team", "season"], "qty", "entity_id")
    birth = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("entity_id") % 3000).cast("int"))
    return top.select("team", "season", "entity_id", "qty", r6(pn.age_on(birth, F.col("season") + 1)).alias("age"))


VALUE_SQL = """
    WITH g AS (SELECT CAST(slot AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS w, ln(avg(ppg) + 1) AS y FROM outcome GROUP BY slot),
    m AS (SELECT sum(w) s0, sum(w*x) s1, sum(w*x*x) s2, sum(w*x*x*x) s3, sum(w*x*x*x*x) s4, sum(w*y) t0, sum(w*x*y) t1, sum(w*x*x*y) t2 FROM g),
    c AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS dt FROM m),
    b AS (SELECT (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2)) / dt AS b0,
                 (s0*(t1*s4 - s3*t2) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2)) / dt AS b1,
                 (s0*(s2*t2 - t1*s3) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2)) / dt AS b2 FROM c)
    SELECT CAST(k AS INTEGER) AS slot, b0 + b1*k + b2*k*k AS log_pred,
           greatest(exp(b0 + b1*k + b2*k*k) - 1, 0) * 100 / (exp(b0 + b1 + b2) - 1) AS worth FROM b, range(1, 263) t(k)"""


def curve_of_slots(spark, d):
    return pn.value_curve(base.outcome(spark, d), "slot", "ppg", presets.LAST_SLOT)


@query("value_curve", f"SELECT slot, round(log_pred, 5) AS log_pred, round(worth, 4) AS worth FROM ({VALUE_SQL})")
def value_curve(spark, d):
    return curve_of_slots(spark, d).select("slot", F.round("log_pred", 5).alias("log_pred"), F.round("worth", 4).alias("worth"))


@query("curve_lookup", f"""
    WITH v AS (SELECT * FROM ({VALUE_SQL}))
    SELECT entity_id, round(worth, 4) AS worth FROM cohort LEFT JOIN v ON v.slot = greatest(1, least(262, CAST(round_even(cohort.slot * 1.5, 0) AS INTEGER)))""")
def curve_lookup(spark, d):
    key = pn.curve_key(F.col("slot") * F.lit(1.5), (1, presets.LAST_SLOT))
    c = base.cohort(spark, d).select("entity_id", key.alias("slot"))
    return attach(c, curve_of_slots(spark, d).select("slot", "worth"), ["slot"]).select("entity_id", F.round("worth", 4).alias("worth"))


@query("capital_delta", f"""
    WITH v AS (SELECT * FROM ({VALUE_SQL})), p AS (SELECT entity_id, slot, CASE WHEN entity_id % 3 <> 0 THEN 1 + (slot * 7) % 262 END AS projected FROM cohort)
    SELECT p.entity_id, p.projected, round(a.worth - b.worth, 4) AS capital_delta, CASE WHEN p.projected IS NULL THEN 0 ELSE 1 END AS has_projection
    FROM p LEFT JOIN v a ON a.slot = p.slot LEFT JOIN v b ON b.slot = p.projected""")
def capital_delta(spark, d):
    e = F.col("entity_id")
    p = base.cohort(spark, d).select("entity_id", "slot", F.when(e % 3 != 0, 1 + (F.col("slot") * 7) % 262).alias("projected"))
    v = F.broadcast(curve_of_slots(spark, d).select("slot", "worth"))
    out = attach(p, v.withColumnRenamed("worth", "__a"), ["slot"])
    out = attach(out, v.withColumnRenamed("slot", "projected").withColumnRenamed("worth", "__b"), ["projected"])
    return out.select("entity_id", "projected", F.round(F.col("__a") - F.col("__b"), 4).alias("capital_delta"),
                      F.col("projected").isNotNull().cast("int").alias("has_projection"))
