"""Event-log roll-ups: volumes, rates and shares of entities in (team, season) groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.nulls import guarded_ratio, sum0, sum_if
from cohortcast.operators.grouped import attach

GROUP = ("player", "team", "season")


def in_play(df: DataFrame, margin: str = "score_diff", limit: int = 28) -> DataFrame:
    """Events while the outcome was open: known margin within the limit."""
    return df.where(F.abs(margin) <= limit)


def rushing(df: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Carries, yards, long-gain counts and value per entity, as totals and rates."""
    y = F.col("yards")
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("carries"), sum0("yards").alias("rush_yards"),
        F.count_if(y >= 10).alias("explosive"), F.count_if(y >= 15).alias("breakaway"),
        sum0("epa").alias("total_epa"), F.avg("epa").alias("epa_per_rush"), F.count_distinct("game").alias("games"))
    c = F.col("carries")
    return agg.withColumns({
        "ypc": guarded_ratio(F.col("rush_yards"), c),
        "explosive_rate": guarded_ratio(F.col("explosive"), c),
        "breakaway_rate": guarded_ratio(F.col("breakaway"), c),
        "carries_per_game": guarded_ratio(c, F.col("games"))})


def receiving(df: DataFrame, caught: Column, keys: Sequence[str] = GROUP) -> DataFrame:
    """Targets, receptions and value per entity, as totals and rates."""
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("targets"), F.count_if(caught).alias("receptions"),
        sum_if(caught, F.col("yards")).alias("rec_yards"),
        F.count_if(caught & (F.col("yards") >= 20)).alias("explosive_rec"),
        sum0("epa").alias("total_epa_rec"), F.avg("epa").alias("epa_per_target"), F.count_distinct("game").alias("rec_games"))
    t = F.col("targets")
    return agg.withColumns({
        "catch_rate": guarded_ratio(F.col("receptions"), t),
        "yards_per_target": guarded_ratio(F.col("rec_yards"), t),
        "targets_per_game": guarded_ratio(t, F.col("rec_games")),
        "explosive_rec_rate": guarded_ratio(F.col("explosive_rec"), F.col("receptions"))})


def dropbacks(df: DataFrame, attempt: Column, sack: Column, complete: Column, interception: Column,
              keys: Sequence[str] = GROUP, team_keys: Sequence[str] = ("team", "season")) -> DataFrame:
    """Passing attempts and sacks per entity, conditional rates and the share of the team's."""
    late = F.col("down") >= 3
    made = attempt & complete
    agg = df.where(attempt | sack).groupBy(*keys).agg(
        F.count_distinct("game").alias("games"), F.count("*").alias("dropbacks"),
        F.count_if(attempt).alias("attempts"), F.count_if(made).alias("completions"),
        F.count_if(sack).alias("sacks"), F.count_if(attempt & interception).alias("ints"),
        F.count_if(made & (F.col("yards") >= 20)).alias("explosive"),
        sum0("epa").alias("total_epa"), sum_if(attempt, F.col("epa")).alias("total_epa_att"),
        F.avg(F.when(late, F.coalesce("epa", F.lit(0.0)))).alias("late_down_epa"))
    team = agg.groupBy(*team_keys).agg(F.sum("dropbacks").alias("__team"))
    out = attach(agg, team, team_keys)
    n, a = F.col("dropbacks"), F.col("attempts")
    return out.withColumns({
        "epa_per_dropback": guarded_ratio(F.col("total_epa"), n),
        "epa_per_attempt": guarded_ratio(F.col("total_epa_att"), a),
        "completion_pct": guarded_ratio(F.col("completions"), a),
        "sack_rate": guarded_ratio(F.col("sacks"), n),
        "int_rate": guarded_ratio(F.col("ints"), n),
        "negative_play_rate": guarded_ratio(F.col("sacks") + F.col("ints"), n),
        "explosive_rate": guarded_ratio(F.col("explosive"), F.col("completions")),
        "share_of_team": guarded_ratio(n, F.col("__team"))}).drop("__team")


def season_rollup(df: DataFrame, keys: Sequence[str], team: str, yards: Column,
                  families: Mapping[str, tuple[Mapping[str, Column], Column, Column]], rest: Column) -> DataFrame:
    """Season totals rebuilt from events in one pass: per family its counts, yards, scores and longest gain.

    `families` maps a column prefix to (counts: name -> condition, gain, score); yards and scores come from gains only.
    """
    out = [F.max(team).alias(team)]
    for prefix, (counts, gain, score) in families.items():
        out += [F.count_if(condition).alias(name) for name, condition in counts.items()]
        out += [sum_if(gain, yards).cast("bigint").alias(f"{prefix}yds"), F.count_if(gain & score).alias(f"{prefix}td"),
                F.max(F.when(gain, yards)).cast("int").alias(f"{prefix}longest")]
    return df.groupBy(*keys).agg(*out, F.count_if(rest).alias("other"))


def usage_by_kind(rushes: DataFrame, targets: DataFrame, keys: Sequence[str],
                  team_keys: Sequence[str]) -> DataFrame:
    """Involvement from two event kinds: own counts over the team's, per kind and in total."""
    both = rushes.select(*keys, F.lit(1).alias("__rush"), F.lit(0).alias("__pass")).unionByName(
        targets.select(*keys, F.lit(0).alias("__rush"), F.lit(1).alias("__pass")))
    own = both.groupBy(*keys).agg(F.sum("__rush").alias("n_rush"), F.sum("__pass").alias("n_pass"))
    team = own.groupBy(*team_keys).agg(F.sum("n_rush").alias("__tr"), F.sum("n_pass").alias("__tp"))
    out = attach(own, team, team_keys)
    return out.withColumns({
        "usg_rush": F.try_divide(F.col("n_rush"), F.col("__tr")),
        "usg_pass": F.try_divide(F.col("n_pass"), F.col("__tp")),
        "usg_overall": F.try_divide(F.col("n_rush") + F.col("n_pass"), F.col("__tr") + F.col("__tp")),
    }).drop("__tr", "__tp")


def full_combine(left: DataFrame, right: DataFrame, keys: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Full outer join of two per-key aggregates; the listed measures become 0 where one side lacks."""
    return left.join(right, list(keys), "full").fillna(0, subset=list(zero))


def reattribute(df: DataFrame, name: str, team: str, corrupted: str, initial: str, last: str,
                drop_unparsed: bool = False) -> DataFrame:
    """Give plays whose name field holds a description back to the entity they belong to.

    The clean names of a team are counted per (initial, last name); the most frequent one wins.
    """
    from cohortcast.operators.grouped import modal_value
    bad = F.coalesce(F.col(name).rlike(corrupted), F.lit(False))
    clean = df.where(~bad).select(
        team, F.substring(name, 1, 1).alias("__initial"),
        F.regexp_extract(name, r"(\S+)$", 1).alias("__last"), F.col(name).alias("__name"))
    lookup = modal_value(clean, [team, "__initial", "__last"], "__name", "__real")
    probe = df.withColumns({
        "__bad": bad,
        "__initial": F.when(bad, F.regexp_extract(name, initial, 0)),
        "__last": F.when(bad, F.regexp_extract(name, last, 0))})
    if drop_unparsed:
        probe = probe.where(~F.col("__bad") | (F.length("__last") > 0))
    joined = attach(probe, lookup, [team, "__initial", "__last"], null_safe=False)
    return joined.withColumn(name, F.coalesce("__real", name)).drop("__bad", "__initial", "__last", "__real")
