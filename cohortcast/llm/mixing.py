"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is cut into shards of bounded size by a seeded hash, and the documents of a shard, in the order of
that hash, form one stream of words that is cut into blocks of `block_words`. The blocks to take are allotted
twice by highest quotients size / (2 n + 1): to the sources by their targets, then within a source
to its shards by their sizes. A shard takes whole rounds of its blocks and the rest by a seeded permutation of
their numbers. Everything is DataFrame expressions; the running sums see one shard at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.llm.common import WORD, null_safe, text_of, word_count
from cohortcast.session import materialize

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
SEED = 11
STRIDE = 2_147_483_647  # a prime above any block number of a shard


def _seats(claim: Column, unit: Column) -> Column:
    """Highest quotients claim / (2 n + 1) not below unit / 2: the seats at the divisor `unit`."""
    return F.floor(claim / unit + F.lit(0.5)).cast("bigint")


def _settle(cells: DataFrame, group: Sequence[str], claim: str, seats: str, house: str, most: str) -> DataFrame:
    """Correct the seats at the common divisor until they fill `house`.

    Rounding at the divisor leaves at most half a seat per cell to add or take. The cells' next
    quotients (to add) or last ones (to take) are ranked, and as many as needed change by one; no cell exceeds `most`.
    """
    whole = Window.partitionBy(*group)
    over = F.sum(seats).over(whole) - F.col(house)
    cells = cells.withColumn("__over", over)
    add = F.when(F.col(seats) < F.col(most), F.col(claim) / (2 * F.col(seats) + 1))
    take = F.when(F.col(seats) > 0, -F.col(claim) / (2 * F.col(seats) - 1))
    key = F.when(F.col("__over") < 0, add).otherwise(take)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__key").desc_nulls_last(), "__order"))
    changed = cells.withColumn("__key", key).withColumn("__rank", rank)
    step = F.when(F.col("__key").isNotNull() & (F.col("__rank") <= F.abs("__over")), -F.signum("__over")).otherwise(0).cast("bigint")
    return changed.withColumn(seats, F.col(seats) + step).drop("__over", "__key", "__rank")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = TOTAL_SHARE,
                   most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, rank): words wanted of each source.

    Sources in code point order, null last, carry the weights in rotation and share `total_share` of all
    words. With the sources in order of cap per weight, those before the water level stop at `most_times` their
    size and the others share the rest by weight. The windows see one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    listed = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cap = (F.col("source_size") * most_times).cast("double")
    rows = sources.withColumn("rank", F.row_number().over(listed))
    rows = rows.withColumn("__w", F.array(*map(F.lit, weights))[(F.col("rank") - 1) % len(weights)].cast("double")).withColumn("__cap", cap)
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)).alias("__full"),
        F.sum("__w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__open"),
        (F.sum("source_size").over(everything) * total_share).alias("__total"))
    level = (F.col("__total") - F.col("__full")) / F.col("__open")
    below = F.when(level * F.col("__w") <= F.col("__cap"), level)
    rows = rows.withColumn("__level", F.max(below).over(everything))
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__level") * F.col("__w")))
    return rows.select("source", "source_size", target.alias("target"), "rank")


def _measured(docs: DataFrame, seed: int, carry: Sequence[str]) -> DataFrame:
    """Size and seeded mark of every document, with the columns of `docs` named in `carry`."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of())))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("__doc"), F.col("source").cast("string").alias("__source"),
        word_count(text_of()).alias("__n"), mark.alias("__mark"), F.xxhash64(text_of()).alias("__hash"), *carry)


def _shard(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the source's row and the document's shard in it."""
    number = F.conv(F.substring("__mark", 1, 8), 16, 10).cast("bigint")
    return measured.withColumn("__s", null_safe(F.col("__source"))).join(targets, "__s").withColumn(
        "__shard", number % F.col("__shards"))


def _quotas(sharded: DataFrame, block_words: int) -> DataFrame:
    """Blocks to take of every shard."""
    cells = (sharded.groupBy("__s", "__shard", "source_size", "target", "__rank").agg(F.sum("__n").alias("__size"))
             .withColumn("__blocks", F.ceil(F.col("__size") / block_words).cast("bigint"))
             .withColumn("__most", F.col("__blocks") * MOST_TIMES).withColumn("__order", F.col("__shard")))
    unit = F.lit(float(block_words))
    seated = cells.groupBy("__s", "source_size", "target", "__rank").agg(F.sum("__most").alias("__most"))
    house = F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) * TOTAL_SHARE / unit + 0.5).cast("bigint")
    seated = (seated.withColumn("__seats", F.least(_seats(F.col("target"), unit), F.col("__most")))
              .withColumn("__house", house).withColumn("__order", F.col("__rank")).withColumn("__all", F.lit(0)))
    seated = _settle(seated, ["__all"], "target", "__seats", "__house", "__most").select("__s", F.col("__seats").alias("__house"))
    divisor = F.when(F.col("__house") > 0, F.col("source_size") / F.col("__house"))
    quota = F.coalesce(F.least(_seats(F.col("__size"), divisor), F.col("__most")), F.lit(0).cast("bigint"))
    quotas = cells.join(seated, "__s").withColumn("__quota", quota)
    return _settle(quotas, ["__s"], "__size", "__quota", "__house", "__most").select("__s", "__shard", "__blocks", "__quota")


def _picked(docs: DataFrame, carry: Sequence[str], block_words: int, shard_words: int, seed: int) -> DataFrame:
    """Every document with the blocks it touches and how often each is taken.

    The sizes are measured once into a narrow table. Targets (a row per source) and quotas (a row per shard) are
    tables too, so Spark joins them by their measured size: broadcast when small, shuffled when not.
    """
    sizes = materialize(_measured(docs, seed, []), "document-sizes")
    targets = source_targets(sizes.select(F.col("__source").alias("source"), F.col("__n").alias("size")))
    targets = materialize(targets.select(
        null_safe(F.col("source")).alias("__s"), "source_size", "target", F.col("rank").alias("__rank"),
        F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint").alias("__shards")), "source-targets")
    quotas = materialize(_quotas(_shard(sizes, targets), block_words), "shard-quotas")
    rows = _shard(_measured(docs, seed, carry) if carry else sizes, targets)
    stream = (Window.partitionBy("__s", "__shard").orderBy("__mark", "__doc", "__n", "__hash")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("__end", F.sum("__n").over(stream)).join(quotas, ["__s", "__shard"])
            .withColumn("__picks", _picks(block_words, seed)))


def _rounds(block: Column, seed: int) -> Column:
    """How often the mix takes a block: whole rounds, and one more for the seeded first ones."""
    turn = F.pmod(block * F.lit(STRIDE) + F.lit(seed), F.col("__blocks"))
    return F.floor(F.col("__quota") / F.col("__blocks")).cast("bigint") + F.when(turn < F.col("__quota") % F.col("__blocks"), 1).otherwise(0).cast("bigint")


def _picks(block_words: int, seed: int) -> Column:
    """Per block that the document touches: its first and last word in the document, and the times taken."""
    start = F.col("__end") - F.col("__n")
    low = F.floor(start / block_words).cast("bigint")
    high = F.floor((F.col("__end") - 1) / block_words).cast("bigint")
    return F.when(F.col("__n") > 0, F.transform(F.sequence(low, high), lambda b: F.struct(
        (F.greatest(b * block_words, start) - start).alias("from"),
        (F.least((b + 1) * block_words, F.col("__end")) - start).alias("to"),
        _rounds(b, seed).alias("times"))))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """How many words of every document the mix takes.

    Input needs `doc_id`, `text` and `source`; other columns are ignored. Output, one row per input row:
    doc_id, size, source_size, target, taken. A null text has size 0 and gives nothing; a null source is a
    source of its own, listed last; a null doc_id is ordered like the text "null". Rows that repeat a doc_id
    are documents of their own, alike in size interchangeable. Shards follow id and text, so rows without an id spread. An empty table gives an empty result.
    A source's taken words miss its target by less than a block per shard. Reruns agree.
    """
    taken = F.aggregate("__picks", F.lit(0).cast("bigint"), lambda acc, p: acc + (p["to"] - p["from"]) * p["times"])
    return _picked(docs, [], block_words, shard_words, seed).select(
        F.col("__doc").alias("doc_id"), F.col("__n").alias("size"), "source_size", "target",
        F.coalesce(taken, F.lit(0).cast("bigint")).alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each pass over a document that takes words of it.

    A pass that takes the whole document keeps its text as it is. One that takes some of its blocks has their words with
    the blanks that follow them, and `n_chars` set to the new length. A document none of whose blocks
    is taken is not in the mix.
    """
    rows = _picked(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}).withColumns(
        {"doc_id": F.col("__in_doc_id"), "text": F.col("__in_text"), "source": F.col("__in_source")}),
        [f"__in_{c}" for c in docs.columns], block_words, shard_words, seed)
    rows = rows.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(MOST_TIMES))))
    held = F.aggregate("__picks", F.lit(0).cast("bigint"), lambda acc, p: acc + F.when(p["times"] >= F.col("__pass"), p["to"] - p["from"]).otherwise(0))
    rows = rows.withColumn("__held", held).where("__held > 0")
    pieces = F.regexp_extract_all(F.col("__in_text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # one step per word: whether the pass takes the block that holds it
    kept = F.filter(pieces, lambda _, i: _rounds(
        F.floor((F.col("__end") - F.col("__n") + i) / block_words).cast("bigint"), seed) >= F.col("__pass"))
    rows = rows.withColumn("__text", F.when(F.col("__held") < F.col("__n"), F.array_join(kept, "")).otherwise(F.col("__in_text")))
    put = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("__held") < F.col("__n"), F.length("__text").cast("bigint")).otherwise(F.col("__in_n_chars"))
    return rows.select(*[put.get(c, F.col(f"__in_{c}")).alias(c) for c in docs.columns])
