"""Event-log families: rates, conditional statistics, usage, shares."""

from pyspark.sql import functions as F

from cohortcast.operators import events as ev
from cohortcast.operators.grouped import add_group_stats, others_total, share_of_total
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query

def caught():
    return F.col("yards") >= 40


def rounded(df, cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("event_scan", """
    SELECT event_id, player, team, yards FROM plays WHERE season IN (1, 2) AND score_diff IS NOT NULL AND abs(score_diff) <= 28""")
def event_scan(spark, d):
    return ev.in_play(base.plays(spark, d).where(F.col("season").isin(1, 2))).select("event_id", "player", "team", "yards")


RUSH_SQL = """
    SELECT player, team, season, count(*) AS carries, CAST(sum(yards) AS BIGINT) AS rush_yards,
           CAST(sum(CASE WHEN yards >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS explosive,
           CAST(sum(CASE WHEN yards >= 15 THEN 1 ELSE 0 END) AS BIGINT) AS breakaway,
           coalesce(sum(epa), 0) AS total_epa, avg(epa) AS mean_epa, count(DISTINCT game) AS games
    FROM live_plays WHERE kind IN ('click', 'error') GROUP BY player, team, season"""

REC_SQL = """
    SELECT player, team, season, count(*) AS targets,
           CAST(sum(CASE WHEN yards >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS receptions,
           CAST(sum(CASE WHEN yards >= 40 THEN yards ELSE 0 END) AS BIGINT) AS rec_yards,
           coalesce(sum(epa), 0) AS total_epa_rec, avg(epa) AS epa_per_target, count(DISTINCT game) AS rec_games,
           CAST(sum(CASE WHEN yards >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS explosive_rec
    FROM live_plays WHERE kind = 'view' GROUP BY player, team, season"""


def rushes(spark, d):
    return base.live_plays(spark, d).where(F.col("kind").isin("click", "error"))


def targets(spark, d):
    return base.live_plays(spark, d).where(F.col("kind") == "view")


@query("event_rates", f"""
    SELECT player, team, season, carries, rush_yards, explosive, breakaway, games, round(total_epa, 6) AS total_epa,
           round(rush_yards / greatest(carries, 1), 6) AS ypc,
           round(explosive / greatest(carries, 1), 6) AS explosive_rate,
           round(breakaway / greatest(carries, 1), 6) AS breakaway_rate,
           round(carries / greatest(games, 1), 6) AS carries_per_game,
           round(mean_epa, 8) AS epa_per_rush
    FROM ({RUSH_SQL})""")
def event_rates(spark, d):
    # a mean of two-digit values over a power of two can end in a 5 at the seventh digit: keep eight
    return rounded(ev.rushing(rushes(spark, d)).withColumn("epa_per_rush", F.round("epa_per_rush", 8)), (
        "total_epa", "ypc", "explosive_rate", "breakaway_rate", "carries_per_game"))


@query("receiving_rates", f"""
    SELECT player, team, season, targets, receptions, rec_yards, explosive_rec, rec_games, round(total_epa_rec, 6) AS total_epa_rec,
           round(epa_per_target, 8) AS epa_per_target, round(receptions / targets, 6) AS catch_rate, round(rec_yards / targets, 6) AS yards_per_target,
           round(targets / greatest(rec_games, 1), 6) AS targets_per_game, round(explosive_rec / greatest(receptions, 1), 6) AS explosive_rec_rate
    FROM ({REC_SQL})""")
def receiving_rates(spark, d):
    out = ev.receiving(targets(spark, d), caught()).withColumn("epa_per_target", F.round("epa_per_target", 8))
    return rounded(out, ("total_epa_rec", "catch_rate", "yards_per_target", "targets_per_game", "explosive_rec_rate"))


@query("event_conditional_stats", """
    WITH a AS (
      SELECT player, team, season, count(DISTINCT game) AS games, count(*) AS dropbacks,
             CAST(sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS attempts,
             CAST(sum(CASE WHEN kind <> 'error' AND yards >= 35 THEN 1 ELSE 0 END) AS BIGINT) AS completions,
             CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS sacks,
             CAST(sum(CASE WHEN kind <> 'error' AND regexp_matches(kind, '(?i)SIGN') AND yards < 35 THEN 1 ELSE 0 END) AS BIGINT) AS ints,
             CAST(sum(CASE WHEN kind <> 'error' AND yards >= 35 AND yards >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS explosive,
             coalesce(sum(epa), 0) AS total_epa, coalesce(sum(CASE WHEN kind <> 'error' THEN epa END), 0) AS total_epa_att,
             avg(CASE WHEN down >= 3 THEN coalesce(epa, 0) END) AS late_down_epa
      FROM live_plays WHERE kind IN ('purchase', 'signup', 'error') GROUP BY player, team, season)
    SELECT player, team, season, games, dropbacks, attempts, completions, sacks, ints, explosive,
           round(total_epa, 6) AS total_epa, round(total_epa_att, 6) AS total_epa_att, round(late_down_epa, 8) AS late_down_epa,
           round(total_epa / greatest(dropbacks, 1), 8) AS epa_per_dropback,
           round(total_epa_att / greatest(attempts, 1), 8) AS epa_per_attempt,
           round(completions / greatest(attempts, 1), 6) AS completion_pct,
           round(sacks / greatest(dropbacks, 1), 6) AS sack_rate, round(ints / greatest(dropbacks, 1), 6) AS int_rate,
           round((sacks + ints) / greatest(dropbacks, 1), 6) AS negative_play_rate,
           round(explosive / greatest(completions, 1), 6) AS explosive_rate,
           round(dropbacks / sum(dropbacks) OVER (PARTITION BY team, season), 6) AS share_of_team
    FROM a""")
def event_conditional_stats(spark, d):
    kind, yards = F.col("kind"), F.col("yards")
    out = ev.dropbacks(base.live_plays(spark, d), kind.isin("purchase", "signup"), kind == "error",
                       yards >= 35, kind.rlike("(?i)SIGN") & (yards < 35))
    # as in event_rates, means keep eight digits
    out = out.withColumns({c: F.round(c, 8) for c in ("late_down_epa", "epa_per_dropback", "epa_per_attempt")})
    return rounded(out, ("total_epa", "total_epa_att",
                         "completion_pct", "sack_rate", "int_rate", "negative_play_rate", "explosive_rate", "share_of_team"))


@query("event_rollup", """
    SELECT player, season, max(team) AS team, count(*) FILTER (WHERE kind IN ('click', 'error')) AS att,
           CAST(coalesce(sum(yards) FILTER (WHERE kind IN ('click', 'error')), 0) AS BIGINT) AS yds,
           count(*) FILTER (WHERE kind IN ('click', 'error') AND yards >= 95) AS td,
           CAST(max(yards) FILTER (WHERE kind IN ('click', 'error')) AS INTEGER) AS longest,
           count(*) FILTER (WHERE kind = 'view') AS targets, count(*) FILTER (WHERE kind = 'view' AND yards < 60) AS receptions,
           CAST(coalesce(sum(yards) FILTER (WHERE kind = 'view' AND yards < 60), 0) AS BIGINT) AS rec_yds,
           count(*) FILTER (WHERE kind = 'view' AND yards < 60 AND yards >= 55) AS rec_td,
           CAST(max(yards) FILTER (WHERE kind = 'view' AND yards < 60) AS INTEGER) AS rec_longest,
           count(*) FILTER (WHERE kind NOT IN ('click', 'error', 'view')) AS other
    FROM plays GROUP BY player, season""")
def event_rollup(spark, d):
    kind, yards = F.col("kind"), F.col("yards")
    rush, target = kind.isin("click", "error"), kind == "view"
    caught = target & (yards < 60)
    return ev.season_rollup(base.plays(spark, d), ["player", "season"], "team", yards, {
        "": ({"att": rush}, rush, yards >= 95), "rec_": ({"targets": target, "receptions": caught}, caught, yards >= 55)}, ~(rush | target))


@query("event_usage", """
    WITH o AS (
      SELECT player, team, season, CAST(sum(CASE WHEN kind <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n_rush,
             CAST(sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n_pass
      FROM live_plays WHERE kind IN ('click', 'error', 'view') GROUP BY player, team, season)
    SELECT player, team, season, n_rush, n_pass, round(n_rush / sum(n_rush) OVER w, 6) AS usg_rush,
           round(n_pass / sum(n_pass) OVER w, 6) AS usg_pass,
           round((n_rush + n_pass) / sum(n_rush + n_pass) OVER w, 6) AS usg_overall
    FROM o WINDOW w AS (PARTITION BY team, season)""")
def event_usage(spark, d):
    out = ev.usage_by_kind(rushes(spark, d), targets(spark, d), list(ev.GROUP), ["team", "season"])
    return rounded(out, ("usg_rush", "usg_pass", "usg_overall"))


@query("full_outer_combine", f"""
    WITH ru AS ({RUSH_SQL}), re AS ({REC_SQL})
    SELECT player, team, season, coalesce(carries, 0) AS carries, coalesce(rush_yards, 0) AS rush_yards,
           coalesce(targets, 0) AS targets, coalesce(receptions, 0) AS receptions,
           coalesce(carries, 0) + coalesce(targets, 0) AS touches,
           round((coalesce(total_epa, 0) + coalesce(total_epa_rec, 0)) / greatest(coalesce(carries, 0) + coalesce(targets, 0), 1), 6) AS epa_per_play,
           round(receptions / greatest(targets, 1), 6) AS catch_rate
    FROM ru FULL JOIN re USING (player, team, season)""")
def full_outer_combine(spark, d):
    ru = ev.rushing(rushes(spark, d)).select(*ev.GROUP, "carries", "rush_yards", "total_epa")
    re = ev.receiving(targets(spark, d), caught()).select(*ev.GROUP, "targets", "receptions", "total_epa_rec", "catch_rate")
    both = ev.full_combine(ru, re, ev.GROUP, ["carries", "rush_yards", "targets", "receptions", "total_epa", "total_epa_rec"])
    touches = F.col("carries") + F.col("targets")
    return both.select(*ev.GROUP, "carries", "rush_yards", "targets", "receptions", touches.alias("touches"),
                       r6((F.col("total_epa") + F.col("total_epa_rec")) / F.greatest(touches, F.lit(1))).alias("epa_per_play"),
                       r6(F.col("catch_rate")).alias("catch_rate"))


@query("group_share", """
    SELECT entity_id, season, team, qty, round(CAST(qty AS DOUBLE) / sum(qty) OVER w, 6) AS share,
           CAST(sum(qty) OVER w - qty AS BIGINT) AS others
    FROM team_panel WINDOW w AS (PARTITION BY team, season)""")
def group_share(spark, d):
    p = base.team_panel(spark, d).select("entity_id", "season", "team", "qty")
    stats = add_group_stats(p, ["team", "season"], F.sum("qty").alias("__t"))
    return stats.select("entity_id", "season", "team", "qty", r6(F.try_divide(F.col("qty"), F.col("__t"))).alias("share"),
                        F.greatest(F.col("__t") - F.col("qty"), F.lit(0)).alias("others"))


@query("receiving_share", f"""
    SELECT player, team, season, targets, round(CAST(targets AS DOUBLE) / sum(targets) OVER (PARTITION BY team, season), 6) AS target_share,
           CAST(sum(targets) OVER (PARTITION BY team, season) - targets AS BIGINT) AS teammates
    FROM ({REC_SQL})""")
def receiving_share(spark, d):
    t = ev.receiving(targets(spark, d), caught()).select(*ev.GROUP, "targets")
    shared = share_of_total(t, ["team", "season"], "targets", "target_share")
    return others_total(shared, ["team", "season"], "targets", "teammates").withColumn("target_share", r6(F.col("target_share")))
