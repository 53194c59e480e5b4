"""Matching families: seasons, passes, overlays, cascades, peers, retention."""

from pyspark.sql import functions as F

from cohortcast.functions import text as tx
from cohortcast.operators import match
from cohortcast.operators.grouped import attach
from cohortcast.operators.panel import season_transitions
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.names import CN, SCHOOL, SN
from cohortcast.plans.registry import query
from cohortcast.sources.tables import load


@query("best_season", """
    SELECT c.entity_id, b.season AS season_best, b.qty AS qty_best, b.lines AS lines_best, b.team AS team_best
    FROM cohort c LEFT JOIN (
      SELECT c.entity_id, t.season, t.qty, t.lines, t.team,
             row_number() OVER (PARTITION BY c.entity_id ORDER BY (t.team = c.school_id) DESC, t.qty DESC, t.season, t.team) AS rn
      FROM cohort c JOIN team_panel t ON t.entity_id = c.entity_id AND t.season BETWEEN c.cohort_year - 3 AND c.cohort_year - 1) b
    ON b.entity_id = c.entity_id AND b.rn = 1""")
def best_season(spark, d):
    c = base.cohort(spark, d).select("entity_id", "cohort_year", "school_id")
    p = base.team_panel(spark, d).join(c.select("entity_id", "school_id"), "entity_id")
    order = [(F.col("team") == F.col("school_id")).desc(), F.col("qty").desc(), F.col("season").asc(), F.col("team").asc()]
    out = match.best_of_seasons(c, p, "entity_id", "cohort_year", "season", [1, 2, 3], ["qty", "lines", "team"], order, "_best")
    return out.select("entity_id", "season_best", "qty_best", "lines_best", "team_best")


@query("lagged_season", """
    SELECT c.entity_id, f.qty AS qty_final, p.qty AS qty_penult, a.qty AS qty_ante, f.qty - p.qty AS qty_yoy
    FROM cohort c LEFT JOIN panel f ON f.entity_id = c.entity_id AND f.season = c.cohort_year - 1
    LEFT JOIN panel p ON p.entity_id = c.entity_id AND p.season = c.cohort_year - 2
    LEFT JOIN panel a ON a.entity_id = c.entity_id AND a.season = c.cohort_year - 3""")
def lagged_season(spark, d):
    c = base.cohort(spark, d).select("entity_id", "cohort_year")
    out = match.lagged_seasons(c, base.panel(spark, d), "entity_id", "cohort_year", "season",
                               {"final": 1, "penult": 2, "ante": 3}, "qty")
    return out.drop("cohort_year").withColumn("qty_yoy", F.col("qty_final") - F.col("qty_penult"))


def stats_people(spark, d):
    """Statistics side: every person, every second one under a name that no draft row has."""
    clean = tx.clean_name(F.col("person"))
    return base.people(spark, d).select(
        F.when(F.col("person_id") % 2 == 0, clean).otherwise(F.concat(F.lit("unlisted "), clean)).alias("name_clean"), tx.normalize_school(F.col("school")).alias("school_norm"),
        F.col("price").alias("stat"), F.col("size").alias("stat_size"), F.col("person_id").alias("stat_id"))


def draft_people(spark, d):
    """Draft side: some names carry a suffix or a different first name than the statistics."""
    k = F.col("person_id")
    clean = tx.clean_name(F.col("person"))
    last = tx.last_token(tx.strip_suffix(clean))
    return base.people(spark, d).select(
        "person_id", F.when(k % 10 == 3, F.concat(F.lit("zed "), last)).otherwise(clean).alias("name_clean"),
        tx.normalize_school(F.col("school")).alias("school_norm"), "draft_year")


STATS_SQL = f"""SELECT CASE WHEN person_id % 2 = 0 THEN {CN} ELSE 'unlisted ' || {CN} END AS name_clean, {SCHOOL.format('school')} AS school_norm, price AS stat, size AS stat_size,
                       person_id AS stat_id FROM people"""
DRAFT_SQL = rf"""SELECT person_id, CASE WHEN person_id % 10 = 3 THEN 'zed ' || regexp_extract({SN}, '(\S+)$', 1) ELSE {CN} END AS name_clean,
                        {SCHOOL.format('school')} AS school_norm, draft_year FROM people"""
LAST = r"regexp_extract(regexp_replace({0}.name_clean, '\s+(jr|sr|ii|iii|iv|v)$', ''), '(\S+)$', 1)"


@query("two_pass_match", f"""
    WITH st AS ({STATS_SQL}), dr AS ({DRAFT_SQL}),
    s1 AS (SELECT * FROM (SELECT st.*, row_number() OVER (PARTITION BY name_clean
             ORDER BY (school_norm IN (SELECT school_norm FROM dr)) DESC, stat DESC, stat_id) AS rn FROM st) WHERE rn = 1),
    s2 AS (SELECT * FROM (SELECT st.*, {LAST.format('st')} AS last_name, row_number() OVER (
             PARTITION BY {LAST.format('st')}, school_norm ORDER BY stat DESC, stat_id) AS rn FROM st) WHERE rn = 1)
    SELECT dr.person_id, dr.name_clean, dr.school_norm, coalesce(s1.stat, s2.stat) AS stat,
           coalesce(s1.stat_size, s2.stat_size) AS stat_size, coalesce(s1.stat_id, s2.stat_id) AS stat_id,
           CASE WHEN s1.stat_id IS NOT NULL THEN 1 WHEN s2.stat_id IS NOT NULL THEN 2 END AS match_pass
    FROM dr LEFT JOIN s1 ON s1.name_clean = dr.name_clean
    LEFT JOIN s2 ON s1.stat_id IS NULL AND s2.last_name = {LAST.format('dr')} AND s2.school_norm = dr.school_norm""")
def two_pass_match(spark, d):
    return match.two_pass_match(
        draft_people(spark, d).drop("draft_year"), stats_people(spark, d), "person_id", "name_clean", "school_norm",
        ["stat", "stat_size", "stat_id"], [F.col("stat").desc(), F.col("stat_id").asc()])


AUTO_SQL = f"""
    WITH l AS (SELECT person_id, official_id AS score_id, CASE WHEN person_id % 10 = 3 THEN {CN} || ' jr' ELSE {CN} END AS name_clean FROM people),
    r AS (SELECT CASE WHEN person_id % {{missing}} <> 0 THEN official_id END AS score_id,
                 CASE WHEN person_id % 8 = 1 THEN 'unlisted ' || {CN} ELSE {CN} END AS name_clean, price AS stat, person_id AS stat_id FROM people),
    k AS (SELECT 'score_id' AS candidate, 1 AS trust, (SELECT count(score_id) / count(*) FROM l) AS cl, (SELECT count(score_id) / count(*) FROM r) AS cr,
            (SELECT count(DISTINCT score_id) FROM l WHERE score_id IN (SELECT score_id FROM r)) / (SELECT count(DISTINCT score_id) FROM l) AS o
          UNION ALL SELECT 'name_clean', 2, (SELECT count(name_clean) / count(*) FROM l), (SELECT count(name_clean) / count(*) FROM r),
            (SELECT count(DISTINCT name_clean) FROM l WHERE name_clean IN (SELECT name_clean FROM r)) / (SELECT count(DISTINCT name_clean) FROM l)),
    chosen AS (SELECT candidate FROM k ORDER BY CASE WHEN cl >= 0.5 AND cr >= 0.5 AND o >= 0.5 THEN 0 ELSE 1 END,
               CASE WHEN cl >= 0.5 AND cr >= 0.5 AND o >= 0.5 THEN 0 ELSE -o END, trust LIMIT 1),
    lk AS (SELECT l.*, CASE WHEN candidate = 'score_id' THEN score_id ELSE name_clean END AS key FROM l, chosen),
    rk AS (SELECT * FROM (SELECT r.*, candidate, CASE WHEN candidate = 'score_id' THEN score_id ELSE name_clean END AS key, row_number() OVER (
             PARTITION BY CASE WHEN candidate = 'score_id' THEN score_id ELSE name_clean END ORDER BY stat DESC, stat_id) AS rn FROM r, chosen) WHERE rn = 1 AND key IS NOT NULL),
    p AS (SELECT *, regexp_replace(name_clean, '\\s+(jr|sr|ii|iii|iv|v)$', '') AS plain FROM r),
    rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY stat DESC, stat_id) AS rn FROM p) WHERE rn = 1)
    SELECT lk.person_id, CASE WHEN rk.stat_id IS NOT NULL THEN rk.candidate WHEN rp.stat_id IS NOT NULL THEN 'name_clean_stripped' END AS match_key,
           coalesce(rk.stat, rp.stat) AS stat, coalesce(rk.stat_id, rp.stat_id) AS stat_id
    FROM lk LEFT JOIN rk ON rk.key = lk.key
    LEFT JOIN rp ON rk.stat_id IS NULL AND rp.plain = regexp_replace(lk.name_clean, '\\s+(jr|sr|ii|iii|iv|v)$', '')"""


def auto_key(spark, d, missing):
    """Both sides carry a score key and a name; on the statistics side every `missing`-th row lacks the score key."""
    k, clean = F.col("person_id"), tx.clean_name(F.col("person"))
    people = base.people(spark, d)
    left = people.select("person_id", F.col("official_id").alias("score_id"), F.when(k % 10 == 3, F.concat(clean, F.lit(" jr"))).otherwise(clean).alias("name_clean"))
    stats = people.select(F.when(k % missing != 0, F.col("official_id")).alias("score_id"),
                          F.when(k % 8 == 1, F.concat(F.lit("unlisted "), clean)).otherwise(clean).alias("name_clean"), F.col("price").alias("stat"), k.alias("stat_id"))
    return match.auto_key_match(left, stats, "person_id", ["score_id", "name_clean"], "name_clean", ["stat", "stat_id"], [F.col("stat").desc(), F.col("stat_id").asc()])


@query("auto_key_score", AUTO_SQL.format(missing=7))
def auto_key_score(spark, d):
    """Enough rows carry the score key: it is chosen."""
    return auto_key(spark, d, 7)


@query("auto_key_name", AUTO_SQL.format(missing=1))
def auto_key_name(spark, d):
    """The statistics have no score key: the name is chosen."""
    return auto_key(spark, d, 1)


@query("two_pass_coalesce", f"""
    WITH st AS ({STATS_SQL}), dr AS ({DRAFT_SQL}),
    a AS (SELECT name_clean, school_norm, max(stat) AS stat, max(stat_size) AS stat_size FROM st WHERE stat_size > 20 GROUP BY ALL),
    b AS (SELECT name_clean, max(stat) AS stat, max(stat_size) AS stat_size FROM st GROUP BY ALL)
    SELECT dr.person_id, coalesce(a.stat, b.stat) AS stat, coalesce(a.stat_size, b.stat_size) AS stat_size
    FROM dr LEFT JOIN a ON a.name_clean = dr.name_clean AND a.school_norm = dr.school_norm LEFT JOIN b ON b.name_clean = dr.name_clean""")
def two_pass_coalesce(spark, d):
    st = stats_people(spark, d)
    aggs = [F.max("stat").alias("stat"), F.max("stat_size").alias("stat_size")]
    strict = st.where("stat_size > 20").groupBy("name_clean", "school_norm").agg(*aggs)
    loose = st.groupBy("name_clean").agg(*aggs)
    out = match.coalesce_passes(draft_people(spark, d), [(strict, ["name_clean", "school_norm"]), (loose, ["name_clean"])],
                                ["stat", "stat_size"])
    return out.select("person_id", "stat", "stat_size")


@query("overlay_merge", """
    WITH tr AS (SELECT entity_id, cohort_year, ppg, raw_ppg FROM outcome WHERE cohort_year <= 1999),
    sc AS (SELECT entity_id, cohort_year, ppg + 1 AS ppg, CAST(NULL AS DOUBLE) AS raw_ppg FROM outcome WHERE cohort_year >= 1999)
    SELECT entity_id, cohort_year, round(coalesce(sc.ppg, tr.ppg), 6) AS ppg, round(coalesce(sc.raw_ppg, tr.raw_ppg), 6) AS raw_ppg
    FROM tr FULL JOIN sc USING (entity_id, cohort_year)""")
def overlay_merge(spark, d):
    o = base.outcome(spark, d).select("entity_id", "cohort_year", "ppg", "raw_ppg")
    scored = o.where("cohort_year >= 1999").withColumns({"ppg": F.col("ppg") + 1, "raw_ppg": F.lit(None).cast("double")})
    out = match.overlay(o.where("cohort_year <= 1999"), scored, ["entity_id", "cohort_year"], ["ppg", "raw_ppg"])
    return out.withColumns({"ppg": r6(F.col("ppg")), "raw_ppg": r6(F.col("raw_ppg"))})


@query("lookup_cascade", """
    WITH a AS (SELECT entity_id, max(team) AS team FROM team_panel WHERE season = 1995 AND qty > 60 GROUP BY 1),
    b AS (SELECT entity_id, max(team) AS team FROM team_panel WHERE season = 1996 AND qty > 40 GROUP BY 1),
    c AS (SELECT entity_id, max(team) AS team FROM team_panel WHERE season = 1997 GROUP BY 1),
    s AS (SELECT school_id, position, min(entity_id) AS team FROM cohort WHERE slot < 100 GROUP BY ALL)
    SELECT co.entity_id, CAST(coalesce(a.team, b.team, c.team, s.team) AS BIGINT) AS team
    FROM cohort co LEFT JOIN a USING (entity_id) LEFT JOIN b USING (entity_id) LEFT JOIN c USING (entity_id)
    LEFT JOIN s ON s.school_id = co.school_id AND s.position = co.position""")
def lookup_cascade(spark, d):
    tp = base.team_panel(spark, d).where(F.col("season").between(1995, 1997))
    season, qty = F.col("season"), F.col("qty")
    # three keyed sources of one table collapse into conditional maxima of one aggregation
    per_entity = tp.groupBy("entity_id").agg(
        F.max(F.when((season == 1995) & (qty > 60), F.col("team"))).alias("__a"),
        F.max(F.when((season == 1996) & (qty > 40), F.col("team"))).alias("__b"),
        F.max(F.when(season == 1997, F.col("team"))).alias("__c"))
    first = per_entity.select("entity_id", F.coalesce("__a", "__b", "__c").cast("bigint").alias("team"))
    c = base.cohort(spark, d)
    peers = c.where("slot < 100").groupBy("school_id", "position").agg(F.min("entity_id").alias("team"))
    out = match.coalesce_passes(c.select("entity_id", "school_id", "position"),
                                [(first, ["entity_id"]), (peers, ["school_id", "position"])], ["team"])
    return out.select("entity_id", "team")


@query("unique_candidate", """
    SELECT school_id, position, cohort_year, min(entity_id) AS entity_id FROM cohort
    GROUP BY ALL HAVING count(DISTINCT entity_id) = 1""")
def unique_candidate(spark, d):
    return match.unambiguous(base.cohort(spark, d), ["school_id", "position", "cohort_year"], "entity_id")


@query("anti_new_entities", """
    SELECT entity_id, name FROM cohort WHERE entity_id NOT IN (SELECT entity_id FROM panel WHERE season < 1996)""")
def anti_new_entities(spark, d):
    seen = base.panel(spark, d).where("season < 1996").select("entity_id")
    return base.cohort(spark, d).join(seen, "entity_id", "left_anti").select("entity_id", "name")


@query("semi_anti", """
    WITH late AS (SELECT DISTINCT entity_id FROM panel WHERE season = 2001)
    SELECT entity_id, 'kept' AS side FROM cohort WHERE entity_id IN (SELECT entity_id FROM late)
    UNION ALL SELECT entity_id, 'dropped' FROM cohort WHERE entity_id NOT IN (SELECT entity_id FROM late)""")
def semi_anti(spark, d):
    c = base.cohort(spark, d).select("entity_id")
    late = base.panel(spark, d).where("season = 2001").select("entity_id")
    return (c.join(late, "entity_id", "left_semi").withColumn("side", F.lit("kept"))
            .unionByName(c.join(late, "entity_id", "left_anti").withColumn("side", F.lit("dropped"))))


@query("key_intersect", """
    SELECT o_custkey AS entity_id FROM orders WHERE year(o_orderdate) = 1995
    INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001
    EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998""")
def key_intersect(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("y"))

    def keys(y):
        return o.where(F.col("y") == y).select("entity_id")

    return keys(1995).intersect(keys(2001)).subtract(keys(1998))


@query("peer_flag", """
    SELECT c.entity_id, CASE WHEN EXISTS (SELECT 1 FROM cohort e WHERE e.slot <= 32 AND e.school_id = c.school_id
             AND e.position = c.position AND e.cohort_year = c.cohort_year AND e.entity_id <> c.entity_id) THEN 1 ELSE 0 END AS elite_peer
    FROM cohort c""")
def peer_flag(spark, d):
    out = match.peer_flag(base.cohort(spark, d), ["school_id", "position", "cohort_year"], "entity_id", F.col("slot") <= 32, "elite_peer")
    return out.select("entity_id", "elite_peer")


@query("peer_count", """
    SELECT entity_id, count(*) OVER (PARTITION BY school_id, cohort_year) - 1 AS n_peers FROM cohort""")
def peer_count(spark, d):
    return match.peer_count(base.cohort(spark, d), ["school_id", "cohort_year"], "n_peers").select("entity_id", "n_peers")


@query("retention_transition", """
    SELECT r.entity_id, r.season, r.team, n.team AS next_team, coalesce(n.team = r.team, false) AS stayed
    FROM roster r LEFT JOIN roster n ON n.entity_id = r.entity_id AND n.season = r.season + 1""")
def retention_transition(spark, d):
    r = base.roster(spark, d).select("entity_id", "season", "team")
    return season_transitions(r, "entity_id", "season", "team").select("entity_id", "season", "team", "next_team", "stayed")


@query("school_value_lookup", """
    SELECT c.entity_id, t.team_qty FROM cohort c
    LEFT JOIN (SELECT team, season, CAST(sum(qty) AS BIGINT) AS team_qty FROM team_panel GROUP BY ALL) t
    ON t.team = c.school_id AND t.season = c.cohort_year - 1""")
def school_value_lookup(spark, d):
    totals = base.team_panel(spark, d).groupBy(F.col("team").alias("school_id"), (F.col("season") + 1).alias("cohort_year")).agg(
        F.sum("qty").alias("team_qty"))
    return attach(base.cohort(spark, d), totals, ["school_id", "cohort_year"]).select("entity_id", "team_qty")
