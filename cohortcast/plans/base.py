"""Analog tables of the football inputs, derived from the star schema.

Money is summed as whole cents so that sums, ties and ranks do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.operators.grouped import attach, best_row
from cohortcast.operators.panel import shrink_to_group, weighted_best
from cohortcast.session import materialize
from cohortcast.sources.tables import load

MIN_GAMES = 2
SEASONS = 3
PRIOR_WEIGHT = 10


def r6(c: Column) -> Column:
    return F.round(c, 6)


def per_order(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Entity-season panel. Lines are reduced per order on the join key, so the join needs no second
    shuffle of the line items."""
    orders = load(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("season"))
    return (orders.join(per_order(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("entity_id", "season")
            .agg(F.count("*").alias("games"),
                 *[F.sum(c).alias(c) for c in ("lines", "qty", "cents", "returned")]))


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("position"),
        (F.lit(1996) + F.col("c_custkey") % 5).cast("int").alias("cohort_year"),
        (F.lit(1) + F.floor((F.lit(10000) - F.col("c_acctbal")) / 42)).cast("int").alias("slot"),
        F.col("c_nationkey").alias("school_id"), F.col("c_acctbal").alias("rating"))


def outcome_seasons(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Seasons that count for the outcome; `p` is a panel that was written before, here and below."""
    c = cohort(spark, d).select("entity_id", "position", "cohort_year")
    joined = c.join((panel(spark, d) if p is None else p).select("entity_id", "season", "games", "cents"), "entity_id")
    return joined.where(
        F.col("season").between(F.col("cohort_year"), F.col("cohort_year") + SEASONS - 1)
    ).select("entity_id", "position", "cohort_year",
             (F.col("season") - F.col("cohort_year") + 1).alias("season_num"), "games",
             (F.col("cents") / F.lit(3999971.0) / F.col("games")).alias("season_ppg"))


def production(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return weighted_best(
        outcome_seasons(spark, d, p).where(F.col("games") >= MIN_GAMES),
        ["entity_id", "position", "cohort_year"], "season_ppg", "games", "season_num", 2)


def shrunk(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return shrink_to_group(production(spark, d, p), ["position"], "weighted_ppg", "top2_games",
                           PRIOR_WEIGHT, "shrunk_ppg")


def outcome(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    s = shrunk(spark, d, p).select("entity_id", "raw_ppg", "weighted_ppg", "shrunk_ppg", "top2_games", "n_qual")
    return cohort(spark, d).join(s, "entity_id", "left").withColumns({
        "made_it": F.col("shrunk_ppg").isNotNull().cast("int"),
        "ppg": F.coalesce("shrunk_ppg", F.lit(0.0))})


def measures(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entity_id")
    return cohort(spark, d).withColumns({
        "height_in": F.when(e % 13 != 0, (68 + e % 9).cast("int")),
        "weight": F.when(e % 11 != 0, (180 + (e * 7) % 61).cast("int")),
        "forty": F.when(e % 5 != 0, (430 + (e * 13) % 40) / 100.0),
        "age": 20 + ((e * 3) % 50) / 10.0})


def features(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Final and penultimate season before the cohort year, from one pass over the panel."""
    p = panel(spark, d) if p is None else p
    m = measures(spark, d)
    lag = F.col("cohort_year") - F.col("season")
    seasons = (p.join(m.select("entity_id", "cohort_year"), "entity_id").where(lag.isin(1, 2))
               .groupBy("entity_id").agg(
                   *[F.max(F.when(lag == 1, F.col(c))).alias(f"__{c}")
                     for c in ("cents", "lines", "games", "returned")],
                   F.max(F.when(lag == 2, F.col("cents"))).alias("__penult")))
    y = F.col("__cents") / 10000.0
    return m.join(seasons, "entity_id", "left").select(
        *m.columns, y.alias("yards_final"), F.col("__lines").alias("rec_final"),
        F.col("__games").alias("games_final"), (F.col("__penult") / 10000.0).alias("yards_penult"),
        (y / F.col("__lines")).alias("ypr"), (F.col("__returned") / F.col("__lines")).alias("td_rate"),
        (y / F.col("__games")).alias("yards_per_game"))


def outcome_and_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both from one panel, written once: they need other columns of it, so that one plan would read the line items twice."""
    p = materialize(panel(spark, d), "panel")
    return outcome(spark, d, p), features(spark, d, p)


def team_panel(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    supp = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("o_custkey").alias("entity_id"), "season", F.col("s_nationkey").alias("team"))
            .agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("qty")))


def roster(spark: SparkSession, d: str) -> DataFrame:
    """Main team of each entity in each season: largest volume, then lines, then team id."""
    return best_row(team_panel(spark, d), ["entity_id", "season"],
                    [F.col("qty").desc(), F.col("lines").desc(), F.col("team").asc()])


def plays(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", F.col("user_id").alias("player"), (F.col("user_id") % 10).cast("int").alias("team"),
        (1 + F.col("user_id") % 3).cast("int").alias("season"), F.to_date("ts").alias("game"),
        F.col("event_type").alias("kind"),
        F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int").alias("yards"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("epa"), (1 + F.col("event_id") % 4).cast("int").alias("down"),
        F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 71).cast("int") - 35).alias("score_diff"))


def live_plays(spark: SparkSession, d: str) -> DataFrame:
    return plays(spark, d).where(F.abs("score_diff") <= 28)


def people(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")

    def pick(n: int, values: list, default) -> Column:
        out = None
        for i, v in enumerate(values):
            out = F.when(k % n == i, F.lit(v)) if out is None else out.when(k % n == i, F.lit(v))
        return out.otherwise(F.lit(default))

    suffix = (F.when(k % 7 == 0, " Jr.").when(k % 11 == 0, " III").when(k % 13 == 0, " é2").otherwise(""))
    return load(spark, d, "part").select(
        k.alias("person_id"),
        F.concat(F.upper(F.substring("p_name", 1, 1)),
                 F.replace(F.col("p_name").substr(F.lit(2), F.length("p_name")), F.lit(" "), F.lit(" O'")),
                 suffix).alias("person"),
        pick(6, ["Ohio St.", "Miami (FL)", "Ala-Birmingham", "Georgia", "Boise State"], "Ohio State").alias("school"),
        pick(5, ["SEC", "Sun Belt", "Mountain West", None], "Big Ten").alias("conference"),
        pick(4, ["KAN", "GNB", "DAL"], "SD").alias("team"),
        F.when(k % 9 != 0, F.concat_ws("-", (5 + k % 2).cast("string"), (k % 12).cast("string")))
        .otherwise("n/a").alias("ht"),
        F.when(k % 4 != 0, F.concat(F.lit("X"), k.cast("string"))).alias("official_id"),
        (2000 + k % 20).cast("int").alias("draft_year"), F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"))


def oos_raw(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic out-of-sample style predictions beside the true outcomes."""
    e = F.col("entity_id")
    return outcome(spark, d).select(
        "entity_id", "name", "position", F.col("cohort_year").alias("test_year"), "slot", "made_it", "ppg",
        F.least(F.lit(6), 1 + F.floor((F.col("slot") - 1) / 44)).cast("int").alias("round"),
        (((e * 7919) % 997) / 1994.0 + F.lit(0.45) * F.col("made_it") + 0.02).alias("p_made_it"),
        (1 + ((e * 104729) % 10007) / 1250.875).alias("prod_pred"),
        (((e * 31) % 1013) / 1013.0).alias("u1"), (((e * 57) % 499) / 499.0).alias("u2"))


def oos(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entity_id")
    return oos_raw(spark, d).withColumns({
        "p_iso": F.lit(0.9) * F.col("p_made_it") + 0.03,
        "exp_ppg": F.col("p_made_it") * F.col("prod_pred"),
        "exp_ppg_bucket": F.when(e % 19 != 0, 0.5 * F.col("ppg") + 4 * F.col("u1")),
        "comp_ppg": F.when(e % 23 != 0, 0.6 * F.col("ppg") + 3 * F.col("u2"))})


def bucket_probs(spark: SparkSession, d: str) -> DataFrame:
    """Two probability vectors over five buckets per row, held as arrays."""
    e = F.col("entity_id")

    def weights(mult: int, add: int, mod: int) -> Column:
        return F.array(*[(1 + (e * (2 * i + mult) + add * i) % mod) / float(mod) for i in range(5)])

    def normalised(c: str) -> Column:
        total = F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.col(c), lambda x: x / total)

    return (oos_raw(spark, d).select("entity_id", "position", "test_year", "ppg",
                                     weights(3, 5, 101).alias("w"), weights(5, 7, 103).alias("v"))
            .select("entity_id", "position", "test_year", "ppg",
                    normalised("w").alias("p"), normalised("v").alias("q")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "attach")]
