"""Joins that recover identities across imperfect sources, without growing the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.text import last_token, strip_suffix
from cohortcast.operators.grouped import attach, best_row, top_per_group
from cohortcast.session import materialize


def add_stripped_variants(df: DataFrame, name: str, keep: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add a suffix-free copy of each suffixed row, then keep the best row per (name, *keep)."""
    stripped = strip_suffix(F.col(name))
    copies = df.where(stripped != F.col(name)).withColumn(name, stripped)
    return best_row(df.unionByName(copies), [name, *keep], order)


def two_pass_match(left: DataFrame, stats: DataFrame, left_id: str, name: str, school: str,
                   values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exact name first, then last name and school for the rows still without a match.

    Names shared by several `stats` rows are resolved by (school known on the left, `order`) in the
    first pass and by `order` in the second. The result has exactly the rows of `left`.
    """
    known = left.select(F.col(school).alias("__school")).distinct().withColumn("__known", F.lit(1))
    first = best_row(
        stats.join(known, stats[school] == F.col("__school"), "left").drop("__school"),
        [name], [F.col("__known").desc_nulls_last(), *order])
    pass1 = attach(left, first.select(name, *values, F.lit(1).alias("match_pass")), [name], null_safe=False)
    hit = pass1.where(F.col("match_pass").isNotNull())
    missed = pass1.where(F.col("match_pass").isNull()).drop(*values, "match_pass")
    surname = last_token(strip_suffix(F.col(name)))
    second = best_row(stats.withColumn("__last", surname), ["__last", school], order).select(
        "__last", school, *values, F.lit(2).alias("match_pass"))
    pass2 = attach(missed.withColumn("__last", surname), second, ["__last", school], null_safe=False).drop("__last")
    return hit.unionByName(pass2)


def key_profile(left: DataFrame, right: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per candidate key: rows, rows that carry it and distinct values on both sides, and values on both sides, from one pass over each.

    Columns: candidate, trust (1 for the first), n_left, n_right, in_left, in_right, keys_left, keys_right, shared. A side without
    the column carries it nowhere. Values are compared as text.
    """
    def long(df: DataFrame, side: str) -> DataFrame:
        items = [F.struct(F.lit(i + 1).alias("trust"), F.lit(c).alias("candidate"),
                          (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias("key")) for i, c in enumerate(candidates)]
        return df.select(F.explode(F.array(*items)).alias("k"), F.lit(int(side == "left")).alias("l")).select("k.*", "l")

    sides = long(left, "left").unionByName(long(right, "right"))
    values = sides.groupBy("trust", "candidate", "key").agg(F.sum("l").alias("n_left"), F.sum(1 - F.col("l")).alias("n_right"))
    here, is_left, is_right = F.col("key").isNotNull(), F.col("n_left") > 0, F.col("n_right") > 0
    return values.groupBy("trust", "candidate").agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"),
        F.sum(F.when(here, F.col("n_left")).otherwise(0)).alias("in_left"), F.sum(F.when(here, F.col("n_right")).otherwise(0)).alias("in_right"),
        F.count_if(here & is_left).alias("keys_left"), F.count_if(here & is_right).alias("keys_right"), F.count_if(here & is_left & is_right).alias("shared"))


def chosen_key(profile: DataFrame, min_coverage: float, min_overlap: float) -> DataFrame:
    """One row (candidate): the most trusted key that enough rows of both sides carry and enough of the left's values are found by,
    else the one whose values overlap most."""
    coverage = F.least(F.try_divide("in_left", "n_left"), F.try_divide("in_right", "n_right"))
    overlap = F.coalesce(F.try_divide("shared", "keys_left"), F.lit(0.0))
    good = F.coalesce((coverage >= min_coverage) & (overlap >= min_overlap), F.lit(False))
    rank = profile.select("candidate", F.struct(
        F.when(good, 0).otherwise(1).alias("bad"), F.when(good, 0.0).otherwise(-overlap).alias("worse"), "trust").alias("rank"))
    return rank.agg(F.min_by("candidate", "rank").alias("candidate"))


def auto_key_match(left: DataFrame, stats: DataFrame, left_id: str, candidates: Sequence[str], name: str, values: Sequence[str], order: Sequence[Column],
                   min_coverage: float = 0.5, min_overlap: float = 0.5) -> DataFrame:
    """Join on the key that the profile of both sides chooses, then, for rows without a match, on the name without its suffix.

    The choice is data of the same plan. Of several `stats` rows with a key the first in `order` counts, so the result has exactly the
    rows of `left`: its id, match_key (the candidate, `<name>_stripped` in the second pass, null without a match) and the values.
    """
    choice = chosen_key(key_profile(left, stats, candidates), min_coverage, min_overlap).scalar()

    def keyed(df: DataFrame, *keep: str) -> DataFrame:
        of = F.coalesce(*[F.when(F.col("__choice") == c, F.col(c).cast("string")) for c in candidates if c in df.columns], F.lit(None).cast("string"))
        return df.withColumn("__choice", choice).select(*keep, "__choice", of.alias("__key"))

    best = best_row(keyed(stats, *stats.columns).where(F.col("__key").isNotNull()), ["__key"], order).select("__key", *values, F.col("__choice").alias("match_key"))
    first = attach(keyed(left, *left.columns).drop("__choice"), best, ["__key"], null_safe=False).drop("__key")
    hit, missed = first.where(F.col("match_key").isNotNull()), first.where(F.col("match_key").isNull()).drop(*values, "match_key")
    stripped = strip_suffix(F.col(name))
    second = best_row(stats.withColumn("__plain", stripped).where(F.col("__plain").isNotNull()), ["__plain"], order).select(
        "__plain", *values, F.lit(f"{name}_stripped").alias("match_key"))
    again = attach(missed.withColumn("__plain", stripped), second, ["__plain"], null_safe=False).drop("__plain")
    return hit.unionByName(again).select(left_id, "match_key", *values)


def coalesce_passes(left: DataFrame, passes: Sequence[tuple[DataFrame, Sequence[str]]],
                    values: Sequence[str]) -> DataFrame:
    """Several keyed look-ups in order of trust; each value comes from the first that has it.

    Every pass is a DataFrame with one row per its keys, and its keys.
    """
    out = left
    for i, (lookup, keys) in enumerate(passes):
        tagged = lookup.select(*keys, *[F.col(v).alias(f"__{i}_{v}") for v in values])
        out = attach(out, tagged, keys, null_safe=False)
    return out.select(*left.columns, *[
        F.coalesce(*[F.col(f"__{i}_{v}") for i in range(len(passes))]).alias(v) for v in values])


def best_of_seasons(cohort: DataFrame, panel: DataFrame, ids: str, year: str, season: str, lags: Sequence[int],
                    values: Sequence[str], order: Sequence[Column], suffix: str) -> DataFrame:
    """Best of several earlier seasons per entity, its values renamed with a suffix."""
    lagged = [F.col(year) - k for k in lags]
    wide = cohort.select(ids, *[c.alias(f"__y{k}") for c, k in zip(lagged, lags)])
    asked = wide.unpivot([ids], [f"__y{k}" for k in lags], "__lag", season).drop("__lag")
    found = best_row(asked.join(panel, [ids, season]), [ids], order)
    renamed = found.select(ids, F.col(season).alias(f"season{suffix}"), *[F.col(v).alias(v + suffix) for v in values])
    return cohort.join(renamed, ids, "left")


def lagged_seasons(cohort: DataFrame, panel: DataFrame, ids: str, year: str, season: str,
                   lags: dict[str, int], value: str) -> DataFrame:
    """The value of named earlier seasons as columns, from one join with the panel."""
    lag = F.col(year) - F.col(season)
    wide = (cohort.select(ids, year).join(panel.select(ids, season, value), ids)
            .where(lag.isin(*lags.values())).groupBy(ids)
            .agg(*[F.max(F.when(lag == k, F.col(value))).alias(f"{value}_{n}") for n, k in lags.items()]))
    return cohort.join(wide, ids, "left")


def overlay(base: DataFrame, scored: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Scored values win over base values; rows only scored are appended."""
    return base.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values]).join(
        scored.select(*keys, *[F.col(v).alias(f"__s_{v}") for v in values]), list(keys), "full").select(
        *keys, *[F.coalesce(f"__s_{v}", f"__b_{v}").alias(v) for v in values])


def unambiguous(df: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    """Keys that point to exactly one id, with it."""
    return (df.groupBy(*keys).agg(F.min(ids).alias(ids), F.max(ids).alias("__max"))
            .where(F.col(ids) == F.col("__max")).drop("__max"))


def peer_flag(df: DataFrame, keys: Sequence[str], ids: str, elite: Column, out: str) -> DataFrame:
    """1 where another member of the group is elite.

    Smallest and largest elite id of the group answer this without pairing the members.
    """
    tops = df.where(elite).groupBy(*keys).agg(F.min(ids).alias("__lo"), F.max(ids).alias("__hi"))
    other = (F.col("__lo") != F.col(ids)) | (F.col("__hi") != F.col(ids))
    return attach(df, tops, keys, null_safe=False).withColumn(
        out, F.coalesce(other.cast("int"), F.lit(0))).drop("__lo", "__hi")


def peer_count(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Number of other members of the group."""
    sizes = df.groupBy(*keys).agg((F.count("*") - 1).alias(out))
    return attach(df, sizes, keys)


def inner_with_suffixes(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns both sides have besides the keys get a suffix each."""
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).join(
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), list(keys))


# ── nearest texts by edit distance ──────────────────────────────────────────

GRAM = 2


def _grams(text: Column) -> Column:
    """(gram, which) of the text's overlapping pieces of `GRAM` characters, repeats numbered, so that shared pieces can be counted by a join."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, GRAM))
    return F.transform(pieces, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == g)).alias("nth")))


def nearest_texts(asks: DataFrame, texts: DataFrame, ask: str, text: str, k: int) -> DataFrame:
    """The `k` texts of least edit distance for each ask, ties by text: (ask, text, dist), exact, comparing few of them.

    An edit changes at most `GRAM` pieces, so texts of n pieces that share s of them are at least (n - s) / `GRAM` edits apart. An inverted
    index counts the shared pieces; the most promising texts of an ask are compared first, and their k-th distance
    bounds the others: only texts whose least possible distance does not pass it are compared as well. Texts that share no piece are found by
    their length alone. Nulls are left out; equal texts count once.
    """
    a = materialize(asks.select(F.col(ask).alias("ask")).where("ask IS NOT NULL").distinct(), "asks")
    t = materialize(texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct(), "texts")
    index = t.select("text", F.inline(_grams(F.col("text"))))
    shared = a.select("ask", F.inline(_grams(F.col("ask")))).join(index, ["gram", "nth"]).groupBy("ask", "text").agg(F.count("*").alias("shared"))

    def least(common: Column) -> Column:
        longer = F.greatest(F.length("ask"), F.length("text"))
        pieces = F.greatest(longer - GRAM + 1, F.lit(1))
        return F.greatest(F.ceil((pieces - common) / F.lit(GRAM)), F.abs(F.length("ask") - F.length("text")))

    shared = materialize(shared.withColumn("least", least(F.col("shared"))), "shared-grams")
    promising = top_per_group(shared, ["ask"], [F.col("least").asc(), F.col("text").asc()], 8 * k)
    first = promising.withColumn("dist", F.levenshtein("ask", "text"))
    bound = top_per_group(first, ["ask"], [F.col("dist").asc(), F.col("text").asc()], k).groupBy("ask").agg(F.count("*").alias("n"), F.max("dist").alias("far"))
    limits = materialize(attach(a, bound, ["ask"]).select("ask", F.when(F.col("n") >= k, F.col("far")).alias("far")), "text-bounds")
    near = attach(shared, limits, ["ask"]).where(F.col("far").isNull() | (F.col("least") <= F.col("far"))).select("ask", "text")
    # without a shared piece at least pieces / GRAM edits: an ask meets the lengths that its bound allows
    known = t.agg(F.array_sort(F.collect_set(F.length("text")))).scalar()  # one number per length that occurs
    far, length = F.coalesce("far", F.lit(1 << 30)), F.col("length")
    pieces = F.greatest(F.greatest(F.length("ask"), length) - GRAM + 1, F.lit(1))
    lengths = (limits.withColumn("lengths", known).select("ask", "far", F.explode("lengths").alias("length"))
               .where((F.ceil(pieces / F.lit(GRAM)) <= far) & (F.abs(F.length("ask") - length) <= far)).select("ask", "length"))
    apart = lengths.join(t.withColumn("length", F.length("text")), "length").join(shared.select("ask", "text"), ["ask", "text"], "left_anti").select("ask", "text")
    compared = near.unionByName(apart).withColumn("dist", F.levenshtein("ask", "text"))
    return top_per_group(compared, ["ask"], [F.col("dist").asc(), F.col("text").asc()], k)
