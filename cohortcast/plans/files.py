"""Cached page files and cleaned exports: written, read back, extracted."""

from pyspark.sql import functions as F

from cohortcast.operators import pages as pg
from cohortcast.plans import base
from cohortcast.plans.football import MOCK_PATTERNS
from cohortcast.plans.registry import query
from cohortcast.session import materialize, scratch_path
from cohortcast.sources import layouts

PAGE_ROWS = 32  # entries of one page
OLD_UNTIL = 2021  # years up to it have the older layout of entries
SHORT_PAGE = 200  # a shorter page counts as missing


def listing_pages(spark, d):
    """Pages (year, page_no) that list cohort members by team in one of two layouts; every seventh page is a stub."""
    e, page = F.col("entity_id"), F.expr(f"entity_id div {PAGE_ROWS}")
    year = (2020 + page % 4).cast("int")
    body = F.concat_ws(", ", F.regexp_replace("name", "#", " "), F.substring("position", 1, 2), F.concat(F.lit("School "), "school_id", F.lit(", State")))
    team = F.concat(F.lit("Team "), F.col("school_id").cast("string"))
    old = F.concat(F.lit("<b> "), team, F.lit(":  "), body, F.lit(" </b>\n"))
    linked = F.concat(F.lit('<a href="/p/'), e.cast("string"), F.lit('">'), body, F.lit("</a>"))
    new = F.concat(F.lit("<strong>"), team, F.lit(":\n "), F.when(e % 3 == 0, body).otherwise(linked), F.lit("</strong>\n"))
    lines = base.cohort(spark, d).select(page.alias("page_no"), year.alias("year"), "entity_id", F.when(year <= OLD_UNTIL, old).otherwise(new).alias("line"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "line"))), lambda r: r["line"]), "")
    noise = F.lit("<html><body><b>Date: April 28, 2022</b>\n")
    return lines.groupBy("year", "page_no").agg(html.alias("html")).withColumn(
        "html", F.when(F.col("page_no") % 7 == 3, F.lit("<html>moved</html>")).otherwise(F.concat(noise, "html", F.lit("</body></html>"))))


@query("page_files", f"""
    WITH x AS (SELECT entity_id, name, position, school_id, entity_id // {PAGE_ROWS} AS page_no FROM cohort),
    k AS (SELECT *, CAST(2020 + page_no % 4 AS INTEGER) AS year, row_number() OVER (PARTITION BY page_no ORDER BY entity_id) - 1 AS pos FROM x WHERE page_no % 7 <> 3)
    SELECT 'year=' || year || '/page_no=' || page_no AS page, year, page_no, 'Team ' || school_id AS team, replace(name, '#', ' ') AS name,
           substr(position, 1, 2) AS position, 'School ' || school_id || ', State' AS school,
           CAST(row_number() OVER (PARTITION BY year ORDER BY page_no, pos) AS BIGINT) AS pick
    FROM k""")
def page_files(spark, d):
    """Entries of cached page files in the order of their pages, numbered through every year."""
    path = scratch_path(spark, "pages")
    layouts.write_pages(listing_pages(spark, d), path, ["year", "page_no"], "html")
    cached = layouts.read_pages(spark, path, "year INT, page_no BIGINT", shortest=SHORT_PAGE)
    rows = pg.labelled_entries(cached.where("html IS NOT NULL"), ["page", "year", "page_no"], "html", list(MOCK_PATTERNS), ["name", "position", "school"])
    rows = materialize(rows.where(F.col("position").rlike(r"^[A-Z/]{1,8}$")), "page-entries")  # numbered in several steps, read from files once
    return pg.number_in_order(rows, "page_no", "pos", "__at", within=["year"]).select(
        "page", "year", "page_no", "team", "name", "position", "school", (F.col("__at") + 1).alias("pick"))


@query("clean_export", """
    SELECT entity_id, CASE WHEN rating >= 0 THEN round_even(sqrt(rating), 3) END AS root, round_even(yards_final / nullif(games_final, 0), 3) AS per_game,
           CAST(weight AS BIGINT) AS weight FROM features""")
def clean_export(spark, d):
    """Numbers of an export: NaN becomes null, fractions are rounded half to even, whole numbers stay; written and read back."""
    f = base.features(spark, d).select("entity_id", F.sqrt("rating").alias("root"), F.try_divide(F.col("yards_final"), F.col("games_final")).alias("per_game"),
                                       F.col("weight").cast("bigint").alias("weight"))
    path = scratch_path(spark, "clean-export")
    layouts.clean_numbers(f, 3).write.json(path)
    return spark.read.schema("entity_id BIGINT, root DOUBLE, per_game DOUBLE, weight BIGINT").json(path)
