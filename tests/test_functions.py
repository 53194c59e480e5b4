"""Null rules, text keys, scores and rule tables on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortcast import archetypes, presets
from cohortcast.functions import nulls, scores, text
from cohortcast.operators import rules


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row.asDict()


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


def test_null_rules(spark):
    got = one(spark,
              pmax=nulls.pmax_na(lit(None), F.lit(0.0)), pmin=nulls.pmin_na(lit(3.0), F.lit(1.0)),
              unknown=nulls.if_else_na(lit(None, "boolean"), F.lit(1), F.lit(2)),
              inside=nulls.in_or_null(lit(None, "string"), ["a"]), outside=nulls.in_or_null(F.lit("b"), ["a"]),
              zero=nulls.guarded_ratio(F.lit(4.0), F.lit(0)), none=nulls.ratio_or_null(F.lit(4.0), F.lit(0.0)))
    assert got == {"pmax": None, "pmin": 1.0, "unknown": None, "inside": True, "outside": False, "zero": 4.0, "none": None}


def test_name_variants(spark):
    got = one(spark,
              clean=text.clean_name(F.lit("  José O'Neil  Jr. ")), stripped=text.strip_suffix(F.lit("marvin harrison jr")),
              search=text.search_name(F.lit("José O'Neil 2nd")), plain=text.suffix_first_name(F.lit("Kenneth Walker III")),
              school=text.normalize_school(F.lit("Miami St. (OH)")), ala=text.normalize_school(F.lit("Ala-Birmingham")),
              slug=text.slug(F.lit("A.J. Brown"), F.lit(2019)), feet=text.feet_inches(F.lit("6-2")), bad=text.feet_inches(F.lit("tall")),
              team=text.recode(F.lit("KAN"), presets.TEAM_ALIASES), keep=text.recode(F.lit("DAL"), presets.TEAM_ALIASES),
              key=text.identity_key(lit(None, "string"), F.lit("WR"), F.lit(2020)), empty=text.identity_key(F.lit(""), F.lit("x")),
              commas=text.count_delimiter(F.lit("a, b, c"), ","))
    assert got == {"clean": "jos oneil jr", "stripped": "marvin harrison", "search": "jose oneil 2nd", "plain": "kenneth walker",
                   "school": "miami state", "ala": "alabama birmingham", "slug": "a-j-brown-2019", "feet": 74, "bad": None,
                   "team": "KC", "keep": "DAL", "key": "fallback|WR|2020", "empty": "fallback|x", "commas": 2}


def test_buckets_at_their_cuts(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.01, 4.42, 4.43, 7.62, 9.75, None)], "v DOUBLE")
    got = [r[0] for r in df.select(scores.assign_bucket(F.col("v"), F.lit("WR"))).collect()]
    assert got == [0, 1, 1, 2, 3, 4, None]


@pytest.mark.parametrize("p", [0.0, 1.0, 0.36])
def test_combiners_stay_probabilities(spark, p):
    for pos, want in {"WR": min(1, 0.85 * p ** 0.5), "RB": max(0, p - 0.05), "TE": p}.items():
        got = one(spark, x=scores.deployed_combiner(F.lit(pos), F.lit(p), F.lit(p)))["x"]
        assert got == pytest.approx(want)


def test_blend_without_other_estimate(spark):
    got = one(spark, a=scores.blend(F.lit("WR"), F.lit(10.0), lit(None), presets.HURDLE_WEIGHT),
              b=scores.blend(F.lit("WR"), F.lit(10.0), F.lit(20.0), presets.HURDLE_WEIGHT),
              c=scores.blend(F.lit("K"), F.lit(10.0), F.lit(20.0), presets.HURDLE_WEIGHT))
    assert got == {"a": 10.0, "b": pytest.approx(17.0), "c": 10.0}


def test_cascade_first_hit_and_default(spark):
    df = spark.createDataFrame([(75, 4.40, 1200.0), (None, None, None), (70, 4.36, 850.0)], "height_in INT, forty DOUBLE, rec_yards_final DOUBLE")
    for c in ("weight", "ypr", "rec_final", "rec_td_rate", "pick"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    label = archetypes.style_of(archetypes.RECEIVER_STYLES, archetypes.RECEIVER_DEFAULT)
    assert [r[0] for r in df.select(label).collect()] == ["Alpha WR", "Developmental WR", "Speed WR"]


def test_points_limit_and_fallback(spark):
    hits = rules.points([(F.lit(True), F.lit(t)) for t in "abcd"])
    none = rules.points([(F.lit(False), F.lit("a")), (lit(None, "boolean"), F.lit("b"))], [(F.lit(True), F.lit("last resort"))])
    empty = rules.points([(F.lit(False), F.lit("a"))])
    got = one(spark, hits=hits, none=none, empty=empty)
    assert got == {"hits": ["A", "B", "C"], "none": ["Last resort"], "empty": []}


def test_labelled_points_keep_inner_dots(spark):
    note = F.lit("Bullish: elite speed (4.36s forty); young. Bearish: G5 competition level.")
    labels = ["Bullish", "Bearish"]
    got = one(spark, b=text.labelled_points(note, "Bullish", labels), r=text.labelled_points(note, "Bearish", labels))
    assert got == {"b": ["elite speed (4.36s forty)", "young"], "r": ["G5 competition level"]}
