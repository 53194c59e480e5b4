"""Ordered extraction of repeated patterns from page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.text import count_delimiter, squish
from cohortcast.operators.grouped import attach
from cohortcast.operators.ranks import prefix_counts
from cohortcast.session import materialize

LINK = r'<a href="([^"<>]*)">([^<]*)</a>'


def all_matches(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Every match of a pattern as an array of structs, one field per named group, in page order.

    The page is searched once; the groups are taken from the short matches.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(
        *[F.regexp_extract(m, pattern, i).alias(n) for n, i in groups.items()]))


def number_in_order(df: DataFrame, page: str, pos: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """0-based place among the rows of all pages (of the same `within` values), by page and position; positions may have gaps.

    Rows are ranked within their page, and only one count per page takes part in the running sum, which is spread over ranges.
    """
    keys = [*within, page]
    ranked = df.withColumn("__in_page", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1)
    per_page = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = prefix_counts(per_page, list(within), page, ["__n"]).select(*keys, F.col("__n_below").alias("__before"))
    return attach(ranked, before, keys).withColumn(out, F.col("__before") + F.col("__in_page")).drop("__before", "__in_page")


def extract_links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Links of each page with their order, the path depth and the first path part.

    The links are written once; their counts per page and their rows are read from that small table.
    """
    links = materialize(pages.select(page, all_matches(F.col(html), LINK, {"href": 1, "label": 2}).alias("links")), "page-links")
    per_page = links.groupBy(page).agg(F.sum(F.size("links")).alias("__n"))
    before = prefix_counts(per_page, [], page, ["__n"]).select(page, F.col("__n_below").alias("__before"))
    found = attach(links, before, [page]).select(page, "__before", F.posexplode("links").alias("p", "m"))
    return found.select(page, (F.col("p") + 1).alias("pos"), "m.href", "m.label",
                        count_delimiter(F.col("m.href"), "/").alias("slashes"),
                        F.split(F.col("m.href"), "/", 2)[0].alias("lead"), (F.col("__before") + F.col("p")).alias("global_pos"))


def split_fields(df: DataFrame, text: str, names: list[str], delimiter: str = r"\s*,\s*") -> DataFrame:
    """Split a delimited field into named columns; the last keeps whatever is left over."""
    parts = F.split(F.col(text), delimiter, len(names))
    return df.select("*", *[squish(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def labelled_entries(pages: DataFrame, keys: list[str], html: str, patterns: list[str],
                     names: list[str]) -> DataFrame:
    """`<group>: a, b, c` entries of a page; the first pattern with any match on a page is used.

    Returns one row per entry with at least `len(names) - 1` delimiters, in page order.
    """
    arrays = [all_matches(F.col(html), p, {"team": 1, "body": 2}) for p in patterns]
    chosen = arrays[-1]
    for a in reversed(arrays[:-1]):
        chosen = F.when(F.size(a) > 0, a).otherwise(chosen)
    rows = pages.select(*keys, F.posexplode(chosen).alias("pos", "m")).select(
        *keys, "pos", squish(F.col("m.team")).alias("team"),
        squish(F.regexp_replace(F.regexp_replace(F.col("m.body"), r"^\s*<a[^>]*>", ""), r"</a>\s*$", "")).alias("body"))
    enough = rows.where(count_delimiter(F.col("body"), ",") >= len(names) - 1)
    return split_fields(enough, "body", names).drop("body")
