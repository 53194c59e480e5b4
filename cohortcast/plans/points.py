"""Points for and against every cohort member, from the table of rules."""

import re

from pyspark.sql import functions as F

from cohortcast import talking_points as tp
from cohortcast.operators import rules
from cohortcast.operators.grouped import add_group_stats
from cohortcast.plans import base
from cohortcast.plans.base import r6
from cohortcast.plans.registry import query
from cohortcast.session import materialize

RECEIVERS = ("BUILDING", "FURNITURE", "MACHINERY")


def point_input(spark, d):
    """Feature rows with the rule inputs: measured ones, a model's probability, and the outcomes of the same position and round."""
    e, slot = F.col("entity_id"), F.col("slot")
    f = base.features(spark, d).drop("ypr").join(
        base.oos(spark, d).select("entity_id", "p_made_it", "ppg", "made_it"), "entity_id").withColumns({
            "round": F.least(F.lit(7), 1 + F.floor((slot - 1) / 32)).cast("int"),
            "role": F.when(F.col("position").isin(*RECEIVERS), tp.RECEIVER).otherwise(tp.BACK),
            "rec_yards": F.col("yards_final") * 10, "rush_yards": F.col("yards_final") * 12,
            "ypr": F.col("yards_final") * 3 / F.col("rec_final"), "ypc": F.col("yards_final") / F.col("rec_final"),
            "share": F.col("td_rate") * 0.7, "back_rec_yards": F.col("yards_penult") * 3,
            "stars": F.when(e % 4 != 0, (2 + e % 4).cast("int")), "tier": F.when(e % 6 == 0, "G5").when(e % 6 < 4, "P5")})
    f = add_group_stats(materialize(f, "point-input"), ["position", "round"],
        F.sum(F.round(F.col("ppg") * 1e6).cast("bigint")).alias("__ppg"), F.sum(1 - F.col("made_it")).alias("__busts"), F.count("*").alias("__n"))
    return f.withColumns({"comp_ppg": F.col("__ppg") / F.col("__n") / 1e6, "bust_rate": F.col("__busts") / F.col("__n")})


INPUT_SQL = f"""
    SELECT *, sum(CAST(round(ppg * 1e6) AS BIGINT)) OVER same / (count(*) OVER same) / 1e6 AS comp_ppg,
           sum(1 - made_it) OVER same / (count(*) OVER same) AS bust_rate
    FROM (SELECT f.* EXCLUDE (ypr), o.p_made_it, o.ppg, o.made_it, CAST(least(7, 1 + floor((f.slot - 1) / 32.0)) AS INTEGER) AS round,
            CASE WHEN f.position IN {RECEIVERS} THEN 'receiver' ELSE 'back' END AS role,
            yards_final * 10 AS rec_yards, yards_final * 12 AS rush_yards, yards_final * 3 / rec_final AS ypr, yards_final / rec_final AS ypc,
            td_rate * 0.7 AS share, yards_penult * 3 AS back_rec_yards, CASE WHEN f.entity_id % 4 <> 0 THEN 2 + f.entity_id % 4 END AS stars,
            CASE WHEN f.entity_id % 6 = 0 THEN 'G5' WHEN f.entity_id % 6 < 4 THEN 'P5' END AS tier
          FROM features f JOIN oos o ON o.entity_id = f.entity_id)
    WINDOW same AS (PARTITION BY position, round)"""


def text_sql(text):
    """The text as one SQL string, placeholders formatted from whole units."""
    def value(m):
        column, form = m.group(1), m.group(2)
        if form == "%":
            return f"' || CAST(round({column} * 100) AS BIGINT) || '"
        if not form:
            return f"' || CAST(floor({column}) AS BIGINT) || '"
        unit = f"1{'0' * int(form)}"
        whole = f"CAST(round({column} * {unit}) AS BIGINT)"
        return f"' || {whole} // {unit} || '.' || lpad(CAST({whole} % {unit} AS VARCHAR), {form}, '0') || '"

    return "'" + re.sub(r"\{(\w+):?([0-9%]?)\}", value, text) + "'"


def side_sql(chains, side):
    """A list of one CASE per chain: rules of the other side end the chain without a point."""
    cases = []
    for c in chains:
        whens = []
        for r in c.rules:
            tests = [f"{t.column} {t.op} " + (f"'{t.value}'" if isinstance(t.value, str) else str(t.value)) for t in r.tests]
            whens.append(f"WHEN {' AND '.join(tests + ([f'role = {c.role!r}'] if c.role else []))} THEN " + (text_sql(r.text) if r.side == side else "NULL"))
        cases.append(f"CASE {' '.join(whens)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def points_sql():
    sides = ", ".join(f"{side_sql(tp.CHAINS, s)} AS {s}_1, {side_sql(tp.FALLBACKS, s)} AS {s}_2" for s in (tp.FOR, tp.AGAINST))
    picked = ", ".join(f"list_transform((CASE WHEN len({s}_1) > 0 THEN {s}_1 ELSE {s}_2 END)[1:{tp.LIMIT}], lambda x: upper(x[1]) || x[2:]) AS {s}_points, "
                       f"len({s}_1) AS n_{s}" for s in (tp.FOR, tp.AGAINST))
    return f"""
        WITH i AS ({INPUT_SQL}), s AS (SELECT entity_id, position, bust_rate, {sides} FROM i), p AS (SELECT entity_id, position, bust_rate, {picked} FROM s)
        SELECT entity_id, position, round(bust_rate, 6) AS bust_rate, array_to_string(for_points, '; ') AS for_points,
               array_to_string(against_points, '; ') AS against_points, n_for, n_against FROM p"""


@query("talking_points", points_sql())
def talking_points(spark, d):
    """The first three points of each side, and how many rules spoke for it."""
    sides = {s: (f"__{s}", f"__{s}_backup") for s in (tp.FOR, tp.AGAINST)}
    fired = point_input(spark, d).select("entity_id", "position", "bust_rate", *[
        rules.fired_points(chains, s, "role").alias(name) for s, names in sides.items() for chains, name in zip((tp.CHAINS, tp.FALLBACKS), names)])
    return fired.select(
        "entity_id", "position", r6(F.col("bust_rate")).alias("bust_rate"),
        *[F.array_join(rules.first_points(F.col(a), F.col(b), tp.LIMIT), "; ").alias(f"{s}_points") for s, (a, b) in sides.items()],
        *[F.size(a).cast("bigint").alias(f"n_{s}") for s, (a, _) in sides.items()])
