"""Flags, filters, formulas and rule tables on the feature rows."""

from pyspark.sql import functions as F

from cohortcast.archetypes import BACK_DEFAULT, BACK_STYLES, RECEIVER_DEFAULT, RECEIVER_STYLES, style_of
from cohortcast.functions import nulls
from cohortcast.functions.scores import speed_score
from cohortcast.operators import rules
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query


@query("nullable_in_filter", """
    SELECT entity_id, height_in, weight FROM features
    WHERE (height_in IN (70, 71, 72) OR height_in IS NULL) AND NOT coalesce(weight IN (180, 181), false)""")
def nullable_in_filter(spark, d):
    return base.features(spark, d).where(
        nulls.in_or_null(F.col("height_in"), [70, 71, 72])
        & ~nulls.is_true(F.col("weight").isin(180, 181))).select("entity_id", "height_in", "weight")


@query("missing_flags", """
    SELECT entity_id, CASE WHEN forty IS NULL THEN 0 ELSE 1 END AS has_forty,
           CASE WHEN yards_final IS NULL THEN 0 ELSE 1 END AS has_final,
           CASE WHEN yards_penult IS NULL THEN 0 ELSE 1 END AS has_penult,
           CASE WHEN height_in <= 71 AND ypr < 5 THEN 1 ELSE 0 END AS possession,
           CASE WHEN weight <= 200 AND td_rate >= 0.3 THEN 1 ELSE 0 END AS scat,
           CASE WHEN (yards_final > 100) IS NULL THEN NULL WHEN yards_final > 100 THEN 'high' ELSE 'low' END AS level
    FROM features""")
def missing_flags(spark, d):
    def flag(c):
        return F.col(c).isNotNull().cast("int")

    def archetype(cond):
        return nulls.is_true(cond).cast("int")

    return base.features(spark, d).select(
        "entity_id", flag("forty").alias("has_forty"), flag("yards_final").alias("has_final"),
        flag("yards_penult").alias("has_penult"),
        archetype((F.col("height_in") <= 71) & (F.col("ypr") < 5)).alias("possession"),
        archetype((F.col("weight") <= 200) & (F.col("td_rate") >= 0.3)).alias("scat"),
        nulls.if_else_na(F.col("yards_final") > 100, F.lit("high"), F.lit("low")).alias("level"))


@query("validity_window", """
    WITH best AS (SELECT school_id, position, cohort_year - 4 + CAST(entity_id % 8 AS INTEGER) AS recruit_year, rating, entity_id,
                         row_number() OVER (PARTITION BY school_id, position ORDER BY rating DESC, entity_id) AS rn FROM cohort),
    m AS (SELECT c.entity_id, c.cohort_year - b.recruit_year AS yrs, b.rating AS stars, b.recruit_year
          FROM cohort c LEFT JOIN best b ON b.rn = 1 AND b.school_id = c.school_id AND b.position = c.position)
    SELECT entity_id, CASE WHEN yrs BETWEEN 2 AND 6 THEN stars END AS stars,
           CASE WHEN yrs BETWEEN 2 AND 6 THEN recruit_year END AS recruit_year,
           CASE WHEN yrs BETWEEN 2 AND 6 THEN yrs END AS college_years,
           CASE WHEN yrs BETWEEN 2 AND 6 THEN 1 ELSE 0 END AS has_recruit FROM m""")
def validity_window(spark, d):
    from cohortcast.operators.grouped import attach, best_row
    c = base.cohort(spark, d)
    recruits = best_row(
        c.select("school_id", "position", F.col("rating").alias("stars"), "entity_id",
                 (F.col("cohort_year") - 4 + (F.col("entity_id") % 8).cast("int")).alias("recruit_year")),
        ["school_id", "position"], [F.col("stars").desc(), F.col("entity_id").asc()]).drop("entity_id")
    m = attach(c.select("entity_id", "cohort_year", "school_id", "position"), recruits, ["school_id", "position"])
    m = m.withColumn("college_years", F.col("cohort_year") - F.col("recruit_year"))
    valid = nulls.is_true(F.col("college_years").between(2, 6))
    return m.select("entity_id", *[F.when(valid, F.col(c)).alias(c) for c in ("stars", "recruit_year", "college_years")],
                    valid.cast("int").alias("has_recruit"))


@query("math_features", """
    SELECT entity_id, round(ln(slot), 6) AS log_slot, round(sqrt(slot), 6) AS sqrt_slot,
           round(weight * 200 / pow(forty, 4), 6) AS speed_score,
           CASE WHEN weight IS NOT NULL THEN least(greatest(weight - 200, 0), 20) END AS over_200,
           round(exp(-slot / 100.0), 6) AS decay, round(abs(age - 22), 6) AS age_gap,
           round(yards_final / greatest(games_final, 1), 6) AS per_game,
           CASE WHEN yards_penult <> 0 THEN round(yards_final / yards_penult, 6) END AS growth
    FROM features""")
def math_features(spark, d):
    f = base.features(spark, d)
    slot = F.col("slot")
    return f.select(
        "entity_id", r6(F.log(slot)).alias("log_slot"), r6(F.sqrt(slot)).alias("sqrt_slot"),
        r6(speed_score(F.col("weight"), F.col("forty"))).alias("speed_score"),
        nulls.clamp(F.col("weight") - 200, 0, 20).cast("int").alias("over_200"),
        r6(F.exp(-slot / 100.0)).alias("decay"), r6(F.abs(F.col("age") - 22)).alias("age_gap"),
        r6(nulls.guarded_ratio(F.col("yards_final"), F.col("games_final"))).alias("per_game"),
        r6(nulls.ratio_or_null(F.col("yards_final"), F.col("yards_penult"))).alias("growth"))


COLUMNS = {"pick": "slot", "rec_td_rate": "td_rate", "rec_yards_final": "ydg", "rec_final": "recs", "ypr": "yprx",
           "recv_share": "share", "rb_rec_yards": "ydr", "carries_final": "recs", "ypc": "ypcx", "rush_yards_final": "ydg"}

RULE_INPUT = """
    SELECT *, yards_final * 10 AS ydg, CAST(rec_final * 20 AS DOUBLE) AS recs, ypr * 3 AS yprx, td_rate * 0.7 AS share,
           yards_final * 2 AS ydr, ypr AS ypcx FROM features"""


def rule_input(spark, d):
    return base.features(spark, d).withColumns({
        "ydg": F.col("yards_final") * 10, "recs": F.col("rec_final") * 20.0, "yprx": F.col("ypr") * 3,
        "share": F.col("td_rate") * 0.7, "ydr": F.col("yards_final") * 2, "ypcx": F.col("ypr")})


WR_SQL = """CASE
    WHEN ydg >= 1100 AND (height_in >= 74 AND forty <= 4.42 OR height_in >= 73 AND td_rate >= 0.12 AND slot <= 15) THEN 'Alpha WR'
    WHEN height_in >= 74 AND weight >= 215 AND (yprx >= 16.5 OR ydg >= 800) THEN 'Contested Catch'
    WHEN forty <= 4.38 AND yprx >= 18 OR forty <= 4.42 AND yprx >= 16.5 AND NOT coalesce(recs >= 70, false) THEN 'Deep Threat'
    WHEN height_in <= 71 AND recs >= 70 THEN 'Slot WR'
    WHEN forty <= 4.42 AND ydg >= 1100 OR forty <= 4.38 AND ydg >= 800 THEN 'Speed WR'
    WHEN recs >= 70 AND NOT coalesce(yprx >= 16.5, false) THEN 'Route Runner'
    WHEN ydg >= 1100 THEN 'High-Volume WR' WHEN yprx >= 16.5 THEN 'Big-Play WR' WHEN forty <= 4.42 THEN 'Speed WR'
    WHEN height_in >= 74 THEN 'Contested Catch' WHEN ydg >= 800 AND yprx >= 15 THEN 'Big-Play WR' WHEN ydg >= 800 THEN 'High-Volume WR'
    WHEN td_rate >= 0.12 THEN 'Big-Play WR' WHEN slot <= 15 THEN 'Alpha WR' WHEN slot <= 40 THEN 'High-Upside WR' ELSE 'Developmental WR' END"""
RB_SQL = """CASE
    WHEN ydg >= 900 AND share >= 0.25 THEN 'Three-Down Back' WHEN ydg >= 1200 AND weight >= 220 AND recs >= 200 THEN 'Workhorse'
    WHEN forty <= 4.38 AND ypcx >= 6 AND ydg >= 1200 THEN 'Explosive Back' WHEN forty <= 4.38 AND ypcx >= 6 THEN 'Speed Back'
    WHEN weight >= 220 AND ydg >= 1200 THEN 'Power Back' WHEN ydg >= 1200 AND (ydr >= 200 OR share >= 0.15) THEN 'All-Purpose Back'
    WHEN ydg >= 1200 AND recs >= 200 THEN 'Workhorse' WHEN forty <= 4.42 AND ydg >= 1200 THEN 'Speed Back' WHEN share >= 0.25 THEN 'Receiving Back'
    WHEN ypcx >= 6 AND ydg >= 1200 THEN 'Big-Play Back' WHEN weight >= 220 AND recs >= 150 THEN 'Power Back' WHEN forty <= 4.42 AND ydg >= 900 THEN 'Speed Back'
    WHEN forty <= 4.42 AND (ydr >= 200 OR share >= 0.15) THEN 'All-Purpose Back' WHEN ydg >= 900 THEN 'Workhorse' WHEN ypcx >= 7 THEN 'Big-Play Back'
    WHEN ydr >= 200 OR share >= 0.15 THEN 'All-Purpose Back' WHEN recs >= 200 THEN 'Workhorse' WHEN slot <= 64 THEN 'High-Upside Back' ELSE 'Developmental Back' END"""


@query("archetype_rules", f"""
    SELECT entity_id, position, CASE WHEN position IN ('BUILDING', 'FURNITURE', 'MACHINERY') THEN {WR_SQL} ELSE {RB_SQL} END AS archetype
    FROM ({RULE_INPUT})""")
def archetype_rules(spark, d):
    receiver = F.col("position").isin("BUILDING", "FURNITURE", "MACHINERY")
    style = F.when(receiver, style_of(RECEIVER_STYLES, RECEIVER_DEFAULT, COLUMNS)).otherwise(style_of(BACK_STYLES, BACK_DEFAULT, COLUMNS))
    return rule_input(spark, d).select("entity_id", "position", style.alias("archetype"))


@query("rule_points", r"""
    WITH f AS (
      SELECT entity_id, slot, list_filter([
        CASE WHEN slot <= 15 THEN 'top-15 pick (#' || slot || ')' WHEN slot <= 40 THEN 'strong draft capital (#' || slot || ')' END,
        CASE WHEN ydg >= 1200 THEN 'elite ' || CAST(floor(ydg) AS BIGINT) || '-yard season'
             WHEN ydg >= 800 THEN 'strong ' || CAST(floor(ydg) AS BIGINT) || '-yard season' END,
        CASE WHEN td_rate >= 0.4 THEN 'elite touchdown rate' END,
        CASE WHEN weight >= 220 AND forty <= 4.45 THEN 'rare size-speed combo (' || weight || ' lbs)'
             WHEN forty <= 4.40 THEN 'elite speed' END,
        CASE WHEN age < 21 THEN 'young for the class' END], lambda x: x IS NOT NULL) AS bull,
        list_filter([CASE WHEN slot >= 180 THEN 'late draft capital limits upside' END,
        CASE WHEN ydg < 600 THEN 'modest production (' || CAST(floor(ydg) AS BIGINT) || ' yards)' END,
        CASE WHEN forty >= 4.58 THEN 'concerning forty' END], lambda x: x IS NOT NULL) AS bear FROM (""" + RULE_INPUT + r""")),
    g AS (SELECT entity_id, CASE WHEN len(bull) > 0 THEN bull[1:3] ELSE ['rd ' || slot || ' pick'] END AS bull,
                 CASE WHEN len(bear) > 0 THEN bear[1:3] WHEN slot > 100 THEN ['slot ' || slot || ' limits opportunity']
                      ELSE CAST([] AS VARCHAR[]) END AS bear FROM f),
    h AS (SELECT entity_id, list_transform(bull, lambda x: upper(x[1]) || x[2:]) AS bull, list_transform(bear, lambda x: upper(x[1]) || x[2:]) AS bear FROM g)
    SELECT entity_id, array_to_string(bull, '; ') AS bullish, array_to_string(bear, '; ') AS bearish,
           len(bull) AS n_bull, len(bear) AS n_bear FROM h""")
def rule_points(spark, d):
    from cohortcast.functions.text import labelled_points
    slot, yards = F.col("slot"), F.col("ydg")
    whole = F.floor(yards)
    bull = rules.points([
        rules.first_of((slot <= 15, F.format_string("top-15 pick (#%d)", slot)),
                       (slot <= 40, F.format_string("strong draft capital (#%d)", slot))),
        rules.first_of((yards >= 1200, F.format_string("elite %d-yard season", whole)),
                       (yards >= 800, F.format_string("strong %d-yard season", whole))),
        (F.col("td_rate") >= 0.4, F.lit("elite touchdown rate")),
        rules.first_of(((F.col("weight") >= 220) & (F.col("forty") <= 4.45),
                        F.format_string("rare size-speed combo (%d lbs)", F.col("weight"))),
                       (F.col("forty") <= 4.40, F.lit("elite speed"))),
        (F.col("age") < 21, F.lit("young for the class")),
    ], [(slot.isNotNull(), F.format_string("rd %d pick", slot))])
    bear = rules.points([
        (slot >= 180, F.lit("late draft capital limits upside")),
        (yards < 600, F.format_string("modest production (%d yards)", whole)),
        (F.col("forty") >= 4.58, F.lit("concerning forty")),
    ], [(slot > 100, F.format_string("slot %d limits opportunity", slot))])
    note = F.concat(F.lit("Bullish: "), F.array_join("bull", "; "), F.lit(". Bearish: "), F.array_join("bear", "; "), F.lit("."))
    noted = rule_input(spark, d).select("entity_id", bull.alias("bull"), bear.alias("bear")).withColumn("note", note)
    labels = ["Bullish", "Bearish"]
    parsed = noted.select("entity_id", labelled_points(F.col("note"), "Bullish", labels).alias("bull"),
                          labelled_points(F.col("note"), "Bearish", labels).alias("bear"))
    return parsed.select("entity_id", F.array_join("bull", "; ").alias("bullish"), F.array_join("bear", "; ").alias("bearish"),
                         F.size("bull").cast("bigint").alias("n_bull"), F.size("bear").cast("bigint").alias("n_bear"))


@query("strengths_concerns", """
    WITH v AS (
      SELECT entity_id, 'size' AS label, CAST((entity_id * 37) % 101 AS DOUBLE) AS pct FROM cohort
      UNION ALL SELECT entity_id, 'speed', CAST((entity_id * 53) % 101 AS DOUBLE) FROM cohort
      UNION ALL SELECT entity_id, 'volume', CASE WHEN entity_id % 6 <> 0 THEN CAST((entity_id * 71) % 101 AS DOUBLE) END FROM cohort
      UNION ALL SELECT entity_id, 'rate', CAST((entity_id * 89) % 101 AS DOUBLE) FROM cohort
      UNION ALL SELECT entity_id, 'youth', CAST((entity_id * 13) % 101 AS DOUBLE) FROM cohort),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pct DESC NULLS LAST, label) AS hi,
                 row_number() OVER (PARTITION BY entity_id ORDER BY pct NULLS LAST, label) AS lo FROM v)
    SELECT entity_id, coalesce(string_agg(label, ',' ORDER BY hi) FILTER (WHERE pct >= 65 AND hi <= 3), '') AS strengths,
           coalesce(string_agg(label, ',' ORDER BY lo) FILTER (WHERE pct <= 40 AND lo <= 2), '') AS concerns
    FROM r GROUP BY entity_id""")
def strengths_concerns(spark, d):
    e = F.col("entity_id")
    pct = {"size": (e * 37) % 101, "speed": (e * 53) % 101, "volume": F.when(e % 6 != 0, (e * 71) % 101),
           "rate": (e * 89) % 101, "youth": (e * 13) % 101}
    pct = {k: v.cast("double") for k, v in pct.items()}
    return base.cohort(spark, d).select(
        "entity_id", F.array_join(rules.strengths(pct, 65, 3), ",").alias("strengths"),
        F.array_join(rules.concerns(pct, 40, 2), ",").alias("concerns"))
