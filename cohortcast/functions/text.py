"""Name, place and page text keys, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortcast.presets import ACCENT_FROM, ACCENT_TO, SUFFIX_DOT_PATTERN, SUFFIX_PATTERN


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_name(x: Column) -> Column:
    """Lower case, letters a-z and spaces only. Accented letters are dropped."""
    return squish(F.regexp_replace(F.lower(x), r"[^a-z ]", ""))


def strip_suffix(x: Column) -> Column:
    """Remove one trailing generational suffix from a cleaned name."""
    return F.regexp_replace(x, SUFFIX_PATTERN, "")


def fold_accents(x: Column) -> Column:
    return F.translate(x, ACCENT_FROM, ACCENT_TO)


def search_name(x: Column) -> Column:
    """Variant for look-ups: accents folded to ASCII, digits kept."""
    return squish(F.regexp_replace(fold_accents(F.lower(x)), r"[^a-z0-9 ]", ""))


def suffix_first_name(x: Column) -> Column:
    """Variant that removes the suffix (with or without a dot) before the letters-only filter."""
    bare = F.regexp_replace(F.lower(x), SUFFIX_DOT_PATTERN, "")
    return squish(F.regexp_replace(bare, r"[^a-z ]", ""))


def normalize_school(x: Column) -> Column:
    """Bring two spellings of a school name to one form."""
    steps = (
        (r"\.", ""),
        (r"\bst\b", "state"),
        (r"\s*\([^)]+\)", ""),
        (r"ala-", "alabama "),
        (r"la-", "louisiana "),
    )
    out = F.lower(x)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return squish(out)


def recode(x: Column, table: Mapping[str, str]) -> Column:
    """Dictionary replacement for a small fixed table; other values pass through."""
    flat = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), x), x)


def last_token(x: Column) -> Column:
    return F.regexp_extract(x, r"(\S+)$", 1)


def first_initial(x: Column) -> Column:
    return F.substring(x, 1, 1)


def slug(name: Column, year: Column) -> Column:
    """File-safe identifier `<name>-<year>`."""
    dashed = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit("-"), year.cast("string"))


def feet_inches(x: Column) -> Column:
    """'6-2' to 74 inches; anything else is null."""
    feet = F.regexp_extract(x, r"^(\d+)-(\d+)$", 1).try_cast("int")
    inches = F.regexp_extract(x, r"^(\d+)-(\d+)$", 2).try_cast("int")
    return feet * 12 + inches


def identity_key(official_id: Column, *fallback: Column) -> Column:
    """Official id where there is one, else a composite of descriptive columns.

    Built before any join so that two missing ids never match each other.
    """
    composite = F.concat_ws("|", F.lit("fallback"), *[c.cast("string") for c in fallback])
    has_id = official_id.isNotNull() & (official_id.cast("string") != "")
    return F.when(has_id, F.concat(F.lit("id:"), official_id.cast("string"))).otherwise(composite)


def count_delimiter(x: Column, delimiter: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))


def capitalise_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def labelled_points(text: Column, label: str, labels: Sequence[str]) -> Column:
    """Points listed after `label:` in a flat note, up to the next label, as an array."""
    nexts = "|".join(labels)
    part = F.regexp_extract(text, rf"(?is){label}:\s*(.*?)(?=\s*(?:{nexts}):|$)", 1)
    part = F.trim(F.regexp_replace(F.trim(part), r"\.$", ""))
    pieces = F.transform(F.split(part, ";"), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")
