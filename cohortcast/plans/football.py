"""The football tables, from landed raw inputs to scored classes, as DataFrame -> DataFrame steps.

Input columns are those of `RAW`; `layouts.conform` brings a source with drifting columns to them.
Every step handles all classes and positions in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast import presets
from cohortcast.functions import scores as sc
from cohortcast.functions import text as tx
from cohortcast.functions.nulls import is_true, pmax_na, sum0
from cohortcast.operators import comps as cp
from cohortcast.operators import events as ev
from cohortcast.operators import pages as pg
from cohortcast.operators import panel as pn
from cohortcast.operators import recipe as rc
from cohortcast.operators.grouped import attach, best_row, zscore_in_group
from cohortcast.operators.match import add_stripped_variants, coalesce_passes
from cohortcast.operators.ranks import percent_ranks, row_index_in_group
from cohortcast.session import materialize
from cohortcast.sources.layouts import conform, optional_lookup

RAW = {
    "draft_picks": "season INT, round INT, pick INT, team STRING, gsis_id STRING, pfr_player_name STRING, position STRING, "
                   "college STRING, age DOUBLE, w_av DOUBLE",
    "rosters": "season INT, team STRING, gsis_id STRING, full_name STRING, position STRING, entry_year INT, birth_date DATE",
    "weekly": "player_id STRING, season INT, season_type STRING, position STRING, team STRING, fantasy_points DOUBLE, "
              "fantasy_points_ppr DOUBLE, targets INT, carries INT",
    "season_stats": "cfb_season INT, player STRING, team STRING, conference STRING, yards DOUBLE",
    "plays": "season INT, season_type STRING, game_id BIGINT, pos_team STRING, offense_conference STRING, play_type STRING, "
             "down INT, score_diff DOUBLE, rush INT, pass_attempt INT, completion INT, sack INT, yds_rushed DOUBLE, "
             "yds_receiving DOUBLE, yards_gained DOUBLE, EPA DOUBLE, rusher_player_name STRING, rush_player STRING, "
             "receiver_player_name STRING, reception_player STRING, passer_player_name STRING, position_target STRING",
}
MIN_GAMES, MAX_SEASON, PRIOR = 6, 3, 16.0


def targets(draft: DataFrame, rosters: DataFrame, weekly: DataFrame, positions: tuple[str, ...] = ("WR", "RB")) -> DataFrame:
    """Outcome of every pick: best two qualifying seasons of the first three, shrunk to the position."""
    picks = conform(draft, RAW["draft_picks"]).where(F.col("position").isin(*positions)).withColumnRenamed("season", "draft_year")
    low = tx.squish(F.lower(F.col("pfr_player_name")))
    bridge = (rosters.where(F.col("position").isin(*positions) & F.col("gsis_id").isNotNull() & F.col("entry_year").isNotNull())
              .groupBy(tx.squish(F.lower(F.col("full_name"))).alias("__name"), F.col("entry_year").alias("draft_year"))
              .agg(F.min("gsis_id").alias("__id")))
    picks = attach(picks.withColumn("__name", low), bridge, ["__name", "draft_year"], null_safe=False)
    picks = picks.withColumn("gsis_id", F.coalesce("gsis_id", "__id")).drop("__name", "__id")
    seasons = (weekly.where((F.col("season_type") == "REG") & F.col("position").isin(*positions))
               .groupBy(F.col("player_id").alias("gsis_id"), "season")
               .agg(F.count("*").alias("games"), sum0((F.col("fantasy_points") + F.col("fantasy_points_ppr")) / 2).alias("points")))
    keyed = picks.where(F.col("gsis_id").isNotNull()).select("gsis_id", "position", "draft_year")
    num = F.col("season") - F.col("draft_year") + 1
    ready = keyed.join(seasons, "gsis_id").where(num.between(1, MAX_SEASON) & (F.col("games") >= MIN_GAMES)).select(
        "gsis_id", "position", "draft_year", num.alias("season_num"), "games", (F.col("points") / F.col("games")).alias("season_ppg"))
    best = pn.weighted_best(ready, ["gsis_id", "position", "draft_year"], "season_ppg", "games", "season_num", 2)
    shrunk = pn.shrink_to_group(best, ["position"], "weighted_ppg", "top2_games", PRIOR, "shrunk_ppg")
    out = attach(picks, shrunk.select("gsis_id", "draft_year", "raw_ppg", "weighted_ppg", "shrunk_ppg", "top2_games", "n_qual"),
                 ["gsis_id", "draft_year"], null_safe=False)
    return out.withColumns({"made_it": F.col("shrunk_ppg").isNotNull().cast("int"), "ppg": F.coalesce("shrunk_ppg", F.lit(0.0))})


def normal_plays(plays: DataFrame) -> DataFrame:
    """One set of names for drifting play columns, in-play rows only, corrupted names given back."""
    p = conform(plays, RAW["plays"])
    p = ev.in_play(p.select(
        "season", F.col("season_type"), F.col("game_id").alias("game"), F.col("pos_team").alias("team"), "play_type", "down", "score_diff",
        F.coalesce("rush", F.lit(0)).alias("rush"), F.coalesce("pass_attempt", F.lit(0)).alias("pass_attempt"),
        F.coalesce("completion", F.lit(0)).alias("completion"), F.coalesce("sack", F.lit(0)).alias("sack"), F.col("EPA").alias("epa"),
        F.coalesce("rusher_player_name", "rush_player").alias("rusher"), F.coalesce("receiver_player_name", "reception_player").alias("receiver"),
        F.col("passer_player_name").alias("passer"), F.coalesce("yds_rushed", "yards_gained").alias("rush_y"),
        F.coalesce("yds_receiving", "yards_gained").alias("rec_y"), F.col("yds_receiving").alias("pass_y"), "position_target"))
    for name in ("rusher", "receiver"):
        p = ev.reattribute(p, name, "team", presets.CORRUPTED_NAME, presets.CORRUPTED_INITIAL, presets.CORRUPTED_LAST)
    return p.where(F.col("team").isNotNull() & (F.col("team") != ""))


def rusher_features(p: DataFrame) -> DataFrame:
    """Carries and targets of one entity in one row, missing side 0."""
    carries = p.where((F.col("rush") == 1) & (F.coalesce("play_type", F.lit("")) != "Sack") & F.col("rusher").isNotNull()
                      & F.col("rush_y").isNotNull()).withColumnsRenamed({"rusher": "player", "rush_y": "yards"})
    thrown = p.where((F.col("pass_attempt") == 1) & F.col("receiver").isNotNull()).withColumnsRenamed({"receiver": "player", "rec_y": "yards"})
    ru = ev.rushing(carries).select(*ev.GROUP, "carries", "rush_yards", "ypc", "explosive_rate", "breakaway_rate", "carries_per_game",
                                    "epa_per_rush", "total_epa")
    re = receiver_features(thrown, named=True).select(*ev.GROUP, "targets", "receptions", "rec_yards", "catch_rate", "targets_per_game",
                                                      "target_share", "total_epa_rec")
    both = ev.full_combine(ru, re, ev.GROUP, ["carries", "targets", "total_epa", "total_epa_rec"])
    touches = F.col("carries") + F.col("targets")
    return both.withColumns({"touches": touches, "epa_per_play": (F.col("total_epa") + F.col("total_epa_rec")) / F.greatest(touches, F.lit(1))})


def receiver_features(p: DataFrame, named: bool = False) -> DataFrame:
    """Target volumes and rates with the share of the team's targets."""
    t = p if named else p.where((F.col("pass_attempt") == 1) & F.col("receiver").isNotNull()).withColumnsRenamed(
        {"receiver": "player", "rec_y": "yards"})
    out = ev.receiving(t, F.col("completion") == 1)
    team = out.groupBy("team", "season").agg(F.sum("targets").alias("__team"))
    return attach(out, team, ["team", "season"]).withColumn(
        "target_share", F.col("targets") / F.greatest(F.col("__team"), F.lit(1))).drop("__team")


def passer_features(p: DataFrame) -> DataFrame:
    named = p.where(F.col("passer").isNotNull() & (F.col("passer") != "")).withColumnsRenamed({"passer": "player", "pass_y": "yards"})
    return ev.dropbacks(named, F.col("pass_attempt") == 1, F.col("sack") == 1, F.col("completion") == 1,
                        F.coalesce("play_type", F.lit("")).rlike("(?i)interception"))


def landing(rosters: DataFrame, weekly: DataFrame) -> DataFrame:
    """Opportunity left behind on each team for the following class, receivers and backs."""
    week = weekly.where((F.col("season_type") == "REG") & F.col("player_id").isNotNull())
    volumes = [sum0(c).cast("bigint").alias(c) for c in ("targets", "carries")]
    own = week.groupBy(F.col("player_id").alias("gsis_id"), "season").agg(*volumes)
    totals = week.groupBy("team", "season").agg(*[sum0(c).cast("bigint").alias(f"team_{c}") for c in ("targets", "carries")])
    roster = best_row(rosters.where(F.col("position").isin("WR", "RB") & F.col("gsis_id").isNotNull()).select(
        "gsis_id", "season", "team", "position", "entry_year", "birth_date"), ["gsis_id", "season"], [F.col("team").asc()])
    # a player returns when the next season lists them on the team as a veteran
    veterans = roster.where(F.col("entry_year") < F.col("season")).select(
        "gsis_id", (F.col("season") - 1).alias("season"), F.col("team").alias("next_team"))
    moves = roster.join(veterans, ["gsis_id", "season"], "left").join(own, ["gsis_id", "season"], "left").withColumn(
        "stayed", is_true(F.col("next_team") == F.col("team")))
    keys, out = ["team", "season"], None
    for pos, volume, bar, short in (("WR", "targets", 50, "wr"), ("RB", "carries", 100, "rb")):
        mine = moves.where(F.col("position") == pos)
        part = pn.vacated_share(mine, keys, volume, bar, totals, f"team_{volume}")
        top = pn.top_incumbent(mine.where(F.col("birth_date").isNotNull()), keys, volume, "gsis_id").select(
            *keys, F.col(volume).alias("__v"), pn.age_on(F.col("birth_date"), F.col("season") + 1).alias(f"incumbent_{short}1_age"))
        part = attach(part, top, keys)
        stem = "tgt" if pos == "WR" else "carry"
        part = part.select(
            *keys, F.col("vacated_share").alias(f"vacated_{stem}_pct"), F.try_divide(F.col("__v"), F.col(f"team_{volume}")).alias(
                f"incumbent_{stem}_share"), F.col("n_returning").alias(f"n_ret_{short}"), f"incumbent_{short}1_age",
            (F.col("n_returning") + 1).cast("double").alias(f"expected_depth_rank_{short}"), F.col(f"team_{volume}").alias(f"team_{volume}_prior"))
        out = part if out is None else out.join(part, keys, "full")
    return out.select(F.col("team").alias("draft_team"), (F.col("season") + 1).alias("draft_year"),
                      *[c for c in out.columns if c not in keys], F.lit(1).alias("has_landing_data"))


def attach_landing(df: DataFrame, table: DataFrame | None) -> DataFrame:
    """Landing columns by normalised team code and class; typed nulls and flag 0 without a table."""
    code = tx.recode(F.col("draft_team"), presets.TEAM_ALIASES)
    if table is None:
        return df.withColumn("has_landing_data", F.lit(0))
    columns = {n: t for n, t in table.dtypes if n not in ("draft_team", "draft_year", "has_landing_data")}
    keyed = best_row(table.withColumn("__code", code), ["__code", "draft_year"], [F.col("draft_team").asc()])
    return optional_lookup(df.withColumn("__code", code), keyed, ["__code", "draft_year"], columns, "has_landing_data").drop("__code")


def dominator_seasons(stats: DataFrame) -> DataFrame:
    """Best yards per (name, school, season) and their share of the school's total."""
    s = conform(stats, RAW["season_stats"])
    totals = s.groupBy(F.col("team").alias("school"), "cfb_season").agg(sum0("yards").alias("team_yards"))
    name = tx.strip_suffix(tx.recode(tx.clean_name(F.col("player")), presets.NAME_ALIASES))
    rows = s.where(~F.col("player").rlike(presets.PLACEHOLDER_NAME)).groupBy(
        name.alias("name_clean"), F.col("team").alias("school"), "cfb_season").agg(F.max(F.coalesce("yards", F.lit(0.0))).alias("yards"))
    return attach(rows, totals, ["school", "cfb_season"], null_safe=False).withColumn(
        "dominator", F.when(F.col("team_yards") > 0, F.col("yards") / F.col("team_yards")))


def prospect_seasons(prospects: DataFrame, seasons: DataFrame) -> DataFrame:
    """Seasons before the draft year of each prospect (name_clean, position, draft_year, draft_age)."""
    p = prospects.select(tx.strip_suffix(F.col("name_clean")).alias("name_clean"), "position", "draft_year", "draft_age")
    return p.join(seasons, "name_clean").where(F.col("cfb_season") < F.col("draft_year")).withColumn(
        "age_in_season", F.col("draft_age") - (F.col("draft_year") - F.col("cfb_season")))


def breakout(prospects: DataFrame, seasons: DataFrame, threshold: float = 0.2) -> DataFrame:
    return pn.first_threshold(prospect_seasons(prospects, seasons), ["name_clean", "position", "draft_year", "draft_age"],
                              "age_in_season", "dominator", "yards", threshold, 22, 21, 23.0, (17, 25))


def dominator_curve(prospects: DataFrame, seasons: DataFrame) -> DataFrame:
    return pn.age_curve(prospect_seasons(prospects, seasons), ["name_clean", "position", "draft_year"], "draft_age", "dominator",
                        presets.AGE_CURVE_RANGE)


MOCK_PATTERNS = (r"(?s)<strong>([^<:]+):\s*(.+?)</strong>", r"<b>\s*([^<:]+?):\s*([^<]+?)\s*</b>")


def mock_consensus(listed: DataFrame, cached_pages: DataFrame) -> DataFrame:
    """Projected pick per (name, class) from a list and from pages (year, page_no, html)."""
    rows = pg.labelled_entries(cached_pages, ["year", "page_no"], "html", list(MOCK_PATTERNS), ["name", "position", "school"])
    rows = rows.where(F.col("position").rlike(r"^[A-Z/]{1,8}$"))
    numbered = row_index_in_group(rows, ["year"], "page_no", "pos", "__at").withColumn("projected_pick", (F.col("__at") + 1).cast("int"))
    scraped = numbered.select(tx.clean_name(F.col("name")).alias("name_clean"), "name", "position", "school",
                              F.col("year").alias("draft_year"), "projected_pick", F.lit("pages").alias("source"))
    own = listed.select(tx.clean_name(F.col("player_name")).alias("name_clean"), F.col("player_name").alias("name"), "position", "school",
                        "draft_year", F.col("ovr_rk").alias("projected_pick"), F.lit("list").alias("source"))
    return best_row(own.unionByName(scraped), ["name_clean", "draft_year"], [F.col("projected_pick").asc_nulls_last(), F.col("source").asc()])


def attach_capital_delta(df: DataFrame, mocks: DataFrame, curve: DataFrame) -> DataFrame:
    """Worth of the actual pick minus worth of the projected one; exact name first, then without suffix."""
    bare = best_row(mocks.withColumn("name_clean", tx.strip_suffix(F.col("name_clean"))), ["name_clean", "draft_year"],
                    [F.col("projected_pick").asc(), F.col("source").asc()])
    named = df.withColumn("__bare", tx.strip_suffix(F.col("name_clean")))
    out = coalesce_passes(named, [
        (mocks.select("name_clean", "draft_year", F.col("projected_pick").alias("proj_pick")), ["name_clean", "draft_year"]),
        (bare.select(F.col("name_clean").alias("__bare"), "draft_year", F.col("projected_pick").alias("proj_pick")), ["__bare", "draft_year"])],
        ["proj_pick"]).drop("__bare")
    worth = curve.select(F.col("slot").alias("pick"), F.col("worth").alias("__actual"))
    asked = curve.select(F.col("slot").alias("__slot"), F.col("worth").alias("__projected"))
    out = attach(out, worth, ["pick"], null_safe=False)
    out = attach(out.withColumn("__slot", pn.curve_key(F.col("proj_pick").cast("double"), (1, presets.LAST_SLOT))), asked, ["__slot"], null_safe=False)
    return out.withColumns({"draft_capital_delta": F.col("__actual") - F.col("__projected"),
                            "has_mock_data": F.col("proj_pick").isNotNull().cast("int")}).drop("__actual", "__projected", "__slot")


def season_lookup(stats: DataFrame, values: list[str], order: str) -> DataFrame:
    """One row per (name, school) for joins: suffix-free copies added, best by `order`."""
    keyed = stats.select(tx.clean_name(F.col("player")).alias("name_clean"), tx.normalize_school(F.col("team")).alias("school_norm"), *values)
    return add_stripped_variants(keyed, "name_clean", ["school_norm"], [F.col(order).desc_nulls_last()])


def tier(conference: Column, school: Column) -> Column:
    return (F.when(school.isin(*presets.P4_SCHOOLS), "P4").when(conference.isin(*presets.G5_CONFERENCES), "G5").otherwise("Other"))


def comp_table(data: DataFrame, position: str, era_normalised: tuple[str, ...] = ()) -> DataFrame:
    """Comparable features of one position with the deployed settings.

    `data`: entity_id, position, draft_year, pick, ppg (null for unfinished classes) and the features.
    """
    spec = cp.CompSpec(presets.COMP_FEATURES[position], presets.COMP_WEIGHTS, year="draft_year", slot="pick")
    mine = data.where(F.col("position") == position)
    have = [f for f in era_normalised if f in spec.features]
    if have:
        z = zscore_in_group(mine, ["draft_year"], have)
        mine = z.drop(*have).withColumnsRenamed({f"{f}_z": f for f in have})
    mine = materialize(mine, "comp-table")
    pool = mine.where(F.col("ppg").isNotNull()).withColumn("comp_ppg", F.col("ppg"))
    params = cp.search_params(pool, cp.cohort_years(mine, "draft_year"), spec)
    return cp.comp_features(mine, cp.nearest_comps(mine, pool, spec, ["comp_ppg"], params), params, spec, "comp_ppg")


def model_ready(df: DataFrame, position: str) -> DataFrame:
    """Derived columns shared by training and scoring, and the era-aware zero fill."""
    out = df.withColumns({
        "log_pick": F.log("pick"), "sqrt_pick": F.sqrt("pick"), "speed_score": sc.speed_score(F.col("weight"), F.col("forty")),
        "has_cfb_data": F.col("yards_final").isNotNull(), "college_tier": tier(F.col("conference"), F.col("college")),
        "yards_yoy": F.col("yards_final") - F.col("yards_penult"),
        "teammate_yards": pmax_na(F.col("team_yards") - F.col("yards_final"), F.lit(0.0))})
    return rc.zero_fill(out, presets.ZERO_FILL[position])


def blended(df: DataFrame) -> DataFrame:
    """Expected outcome: hurdle, then buckets, then comparables, each where it is available."""
    p = F.col("position")
    out = df.withColumn("p_eff", sc.deployed_combiner(p, F.col("p_made_it"), F.coalesce("p_iso", "p_made_it")))
    out = out.withColumn("hurdle_ppg", sc.hurdle(F.col("p_eff"), F.col("log_pred")))
    out = out.withColumn("model_ppg", sc.blend(p, F.col("hurdle_ppg"), F.col("exp_ppg_bucket"), presets.HURDLE_WEIGHT))
    return out.withColumn("exp_ppg", sc.blend(p, F.col("model_ppg"), F.col("comp_weighted_ppg"), presets.MODEL_WEIGHT))


def prospect_scores(df: DataFrame) -> DataFrame:
    """0-100 composite within each position."""
    ready = df.withColumns({"__up": F.coalesce("p_elite", F.lit(0.0)) + F.coalesce("p_league_winner", F.lit(0.0)),
                            "__comp": F.coalesce("comp_weighted_ppg", F.lit(0.0))})
    r = percent_ranks(ready, ["position"], {"__up": "__ru", "exp_ppg": "__re", "__comp": "__rc"})
    has = F.col("p_elite").isNotNull() & F.col("p_league_winner").isNotNull() & F.col("p_bust").isNotNull()
    score = sc.composite_score(F.col("__ru") * 100, F.col("__re") * 100, F.col("__rc") * 100, F.col("p_bust"), F.col("comp_bust_rate"),
                               F.col("p_made_it"), has)
    return r.withColumn("prospect_score", F.bround(score)).drop("__up", "__comp", "__ru", "__re", "__rc")
