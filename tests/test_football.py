"""The football steps on tiny raw tables with the edge rows the inputs are known for."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortcast.plans import football as fb


def frame(spark, table, rows):
    names = [c.split()[0] for c in fb.RAW[table].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fb.RAW[table])


def weeks(pid, season, n, pts, team="KC", **kw):
    return [dict(player_id=pid, season=season, season_type="REG", position=kw.get("position", "WR"), team=team, fantasy_points=pts,
                 fantasy_points_ppr=pts + 2, targets=kw.get("targets", 5), carries=kw.get("carries", 0)) for _ in range(n)]


def test_targets(spark):
    draft = frame(spark, "draft_picks", [
        dict(season=2020, round=1, pick=5, gsis_id="A", pfr_player_name="Al Abe", position="WR"),
        dict(season=2020, round=2, pick=40, gsis_id=None, pfr_player_name="Bo  Bee", position="WR"),
        dict(season=2020, round=7, pick=250, gsis_id=None, pfr_player_name="Cy Coe", position="WR"),
        dict(season=2020, round=1, pick=1, gsis_id="Q", pfr_player_name="Q B", position="QB")])
    rosters = frame(spark, "rosters", [dict(season=2020, team="KC", gsis_id="B", full_name="bo bee", position="WR", entry_year=2020)])
    weekly = frame(spark, "weekly", weeks("A", 2020, 10, 9.0) + weeks("A", 2021, 5, 99.0) + weeks("A", 2022, 8, 19.0) + weeks("A", 2023, 16, 50.0)
                   + weeks("B", 2021, 6, 4.0) + [dict(player_id=None, season=2020, season_type="REG", position="WR", fantasy_points=1.0, fantasy_points_ppr=1.0)])
    got = {r["pfr_player_name"]: r for r in fb.targets(draft, rosters, weekly).collect()}
    assert len(got) == 3
    a, b, c = got["Al Abe"], got["Bo  Bee"], got["Cy Coe"]
    assert a["weighted_ppg"] == pytest.approx((10 * 10 + 8 * 20) / 18) and a["n_qual"] == 2 and b["weighted_ppg"] == 5.0
    prior = (a["weighted_ppg"] + 5.0) / 2
    assert b["shrunk_ppg"] == pytest.approx((6 * 5 + 16 * prior) / 22)
    assert (c["made_it"], c["ppg"], c["raw_ppg"]) == (0, 0.0, None)


def test_play_features(spark):
    base = dict(season=2024, game_id=1, pos_team="X", down=1, score_diff=0.0, EPA=1.0)
    rows = [dict(base, rush=1, rusher_player_name="Jay Love", yds_rushed=y) for y in (3.0, 12.0, 16.0)]
    rows += [dict(base, rush=1, rusher_player_name="#22 J.Love rushed to 38", yards_gained=9.0, EPA=None),
             dict(base, rush=1, rusher_player_name="Jay Love", yds_rushed=50.0, score_diff=29.0),
             dict(base, rush=1, rusher_player_name="Jay Love", yds_rushed=50.0, score_diff=None),
             dict(base, rush=1, rusher_player_name="Jay Love", yds_rushed=-7.0, play_type="Sack"),
             dict(base, pass_attempt=1, completion=1, reception_player="Jay Love", yds_receiving=20.0, passer_player_name="Al Q"),
             dict(base, pass_attempt=1, completion=0, receiver_player_name="Zed Y", yards_gained=0.0, passer_player_name="Al Q", play_type="Interception Return", down=3, EPA=-4.0),
             dict(base, sack=1, passer_player_name="Al Q", play_type="Sack", EPA=-2.0)]
    p = fb.normal_plays(frame(spark, "plays", rows))
    love = {r["player"]: r for r in fb.rusher_features(p).collect()}
    assert love["Jay Love"]["carries"] == 4 and love["Jay Love"]["rush_yards"] == 40.0 and love["Jay Love"]["epa_per_rush"] == 1.0
    assert love["Jay Love"]["breakaway_rate"] == 0.25 and love["Jay Love"]["target_share"] == 0.5 and love["Zed Y"]["carries"] == 0
    q = fb.passer_features(p).first()
    assert (q["dropbacks"], q["attempts"], q["completions"], q["ints"], q["sacks"]) == (3, 2, 1, 1, 1)
    assert q["late_down_epa"] == -4.0 and q["share_of_team"] == 1.0 and q["explosive_rate"] == 1.0


def test_landing_and_team_codes(spark):
    born = datetime.date(1995, 9, 1)
    rosters = frame(spark, "rosters", [
        dict(season=2020, team="KC", gsis_id="A", position="WR", entry_year=2017, birth_date=born), dict(season=2021, team="KC", gsis_id="A", position="WR", entry_year=2017, birth_date=born),
        dict(season=2020, team="KC", gsis_id="B", position="WR", entry_year=2018), dict(season=2021, team="NE", gsis_id="B", position="WR", entry_year=2018)])
    weekly = frame(spark, "weekly", weeks("A", 2020, 10, 1.0, targets=6) + weeks("B", 2020, 10, 1.0, targets=4))
    table = fb.landing(rosters, weekly)
    row = table.where("draft_team = 'KC' and draft_year = 2021").first()
    assert row["vacated_tgt_pct"] == 0.4 and row["incumbent_tgt_share"] == 0.6 and row["n_ret_wr"] == 1 and row["expected_depth_rank_wr"] == 2.0
    assert row["incumbent_wr1_age"] == pytest.approx(9497 / 365.25) and row["vacated_carry_pct"] is None
    picks = spark.createDataFrame([("KAN", 2021), ("DAL", 2021)], "draft_team STRING, draft_year INT")
    got = {r["draft_team"]: r for r in fb.attach_landing(picks, table).collect()}
    assert got["KAN"]["has_landing_data"] == 1 and got["DAL"]["has_landing_data"] == 0 and got["DAL"]["vacated_tgt_pct"] is None
    assert fb.attach_landing(picks, None).first()["has_landing_data"] == 0


def test_breakout(spark):
    stats = frame(spark, "season_stats", [
        dict(cfb_season=2018, player="Brian Thomas Jr.", team="LSU", yards=100.0), dict(cfb_season=2018, player="Other", team="LSU", yards=900.0),
        dict(cfb_season=2019, player="Brian Thomas", team="LSU", yards=300.0), dict(cfb_season=2019, player="Other", team="LSU", yards=700.0),
        dict(cfb_season=2005, player="Brian Thomas", team="LSU", yards=900.0), dict(cfb_season=2019, player="#1 X.Y ran", team="LSU", yards=0.0)])
    who = spark.createDataFrame([("brian thomas jr", "WR", 2020, 21.0)], "name_clean STRING, position STRING, draft_year INT, draft_age DOUBLE")
    r = fb.breakout(who, fb.dominator_seasons(stats)).first()
    assert (r["n_seasons"], r["breakout_age"], r["n_dominant"], r["has_breakout"]) == (2, 20.0, 1, 1) and r["peak_share"] == 0.3 and r["peak_volume"] == 300.0


def test_mocks_and_capital(spark):
    listed = spark.createDataFrame([(2020, "Al Abe Jr.", "WR", "USC", 10)], "draft_year INT, player_name STRING, position STRING, school STRING, ovr_rk INT")
    pages = spark.createDataFrame([(2023, 2, "<b>Jets: Bo Bee, WR, Texas</b>"), (2023, 1, "<b>Bears: Cy Coe, RB, Iowa</b><b>link: 4:30, x, y</b>")], "year INT, page_no INT, html STRING")
    mocks = fb.mock_consensus(listed, pages)
    assert {r["name_clean"]: r["projected_pick"] for r in mocks.collect()} == {"al abe jr": 10, "cy coe": 1, "bo bee": 2}
    curve = spark.createDataFrame([(i, float(100 - i)) for i in range(1, 263)], "slot INT, worth DOUBLE")
    df = spark.createDataFrame([("al abe", 2020, 4), ("bo bee", 2023, 2), ("new", 2023, 9)], "name_clean STRING, draft_year INT, pick INT")
    got = {r["name_clean"]: (r["draft_capital_delta"], r["has_mock_data"]) for r in fb.attach_capital_delta(df, mocks, curve).collect()}
    assert got == {"al abe": (6.0, 1), "bo bee": (0.0, 1), "new": (None, 0)}


def test_blend_chain(spark):
    df = spark.createDataFrame([("RB", 0.8, 0.7, 2.0, 5.0, 9.0), ("TE", 0.5, None, 1.0, None, None)],
                               "position STRING, p_made_it DOUBLE, p_iso DOUBLE, log_pred DOUBLE, exp_ppg_bucket DOUBLE, comp_weighted_ppg DOUBLE")
    rb, te = fb.blended(df).select(F.col("exp_ppg")).collect()
    hurdle = 0.65 * 7.38905609893065
    assert rb[0] == pytest.approx(0.35 * (0.2 * hurdle + 0.8 * 5.0) + 0.65 * 9.0) and te[0] == pytest.approx(0.5 * 2.718281828459045)
