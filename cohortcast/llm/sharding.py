"""Documents to shards by a weighted hash tree: region, rack, shard.

A document's key draws an exponential number -ln(u) / weight for every child of a node, u being a hash of the key and
the child's name, and goes down to the child with the smallest. A child is chosen in proportion to its weight, and as
the draws of its siblings do not depend on it, a changed weight moves rows only into or out of the subtrees
whose weights change. A shard that stands in a region of its own therefore only takes rows, and only into itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.llm.common import text_of
from cohortcast.session import materialize

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
ROW_BYTES = 16
HASH_DIGITS = 13           # hex digits of a draw: 52 bits, exact in a double
SLOT_ROWS = 65_536         # rows numbered in one window
SLOT_DIGITS = 10           # hex digits of the mark that order the windows


@dataclass(frozen=True)
class Tree:
    """{region: {rack: {shard number: weight}}}; names are part of the hashes, so they must not change.

    The tree is a literal of the plan: some thousands of shards at most. Shards of weight 0 take nothing.
    """

    regions: Mapping[str, Mapping[str, Mapping[int, float]]]

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Child names and weights of every inner node that has any weight, by path; the root's path is empty."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        for region, racks in self.regions.items():
            for rack, shards in racks.items():
                if any(w < 0 for w in shards.values()):
                    raise ValueError("weights must not be negative")
                held = [(str(s), float(w)) for s, w in shards.items() if w > 0]
                if held:
                    out[f"/{region}/{rack}"] = held
                    out.setdefault(f"/{region}", []).append((rack, sum(w for _, w in held)))
            if f"/{region}" in out:
                out[""].append((region, sum(w for _, w in out[f"/{region}"])))
        if not out[""]:
            raise ValueError("a tree needs a shard with a weight")
        return out


def layout(shards: int = SHARDS, added: int = 0, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> Tree:
    """Equal weights: `shards` dealt in order to racks and regions, then `added` ones in a region each."""
    regions: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        regions.setdefault(f"r{s // (per_rack * racks)}", {}).setdefault(f"k{s // per_rack % racks}", {})[s] = 1.0
    for s in range(shards, shards + added):
        regions[f"added{s}"] = {"k0": {s: 1.0}}
    return Tree(regions)


def key_of(id_column: str = "doc_id") -> Column:
    """The id as text; null is the key "null"."""
    return F.coalesce(F.col(id_column).cast("string"), F.lit("null"))


def _leading(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def _chosen(key: Column, children: Column) -> Column:
    """Path of the child with the smallest draw; ties go to the smaller path."""
    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit(":"), child["path"]).cast("binary"))
        u = (_leading(digest, HASH_DIGITS) + F.lit(0.5)) / F.lit(float(16 ** HASH_DIGITS))
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["path"].alias("path"))
    return F.array_min(F.transform(children, draw))["path"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number a key goes to: one draw for each child of the root and of the two nodes on its way down."""
    inner = tree.children()
    nodes = F.create_map(*[x for path, held in inner.items() for x in (
        F.lit(path), F.array(*[F.struct(F.lit(f"{path}/{n}").alias("path"), F.lit(w).alias("weight")) for n, w in held]))])
    path = F.lit("")
    for _ in range(3):
        path = _chosen(key, F.element_at(nodes, path))
    return F.substring_index(path, "/", -1).cast("int")


def _slots(rows: DataFrame, total: int, slot_rows: int) -> DataFrame:
    """Add `slot`: gapless from 0 within `shard` in the order of `__mark`, whatever the size of a shard or of a group of equal marks.

    A shard's rows are numbered in ranges of the mark, each with the counts of the ranges before it. Marks with more than
    `slot_rows` rows stand for as many rows in their range, and their rows, which are interchangeable, are numbered in parts.
    """
    shards = rows.select("shard").distinct().count()
    ranges = max(1, -(-total // (slot_rows * max(1, shards))))
    rows = rows.withColumn("__range", F.floor(_leading(F.col("__mark"), SLOT_DIGITS) * ranges / F.lit(16 ** SLOT_DIGITS)).cast("int"))
    per_range = materialize(rows.groupBy("shard", "__range").agg(F.count("*").alias("__n")), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    full = per_range.where(F.col("__n") > slot_rows).select("shard", "__range")
    heavy = rows.join(full, ["shard", "__range"], "left_semi").groupBy("shard", "__range", "__mark").agg(F.count("*").alias("__w"))
    heavy = materialize(heavy.where(F.col("__w") > slot_rows), "shard-copies")

    upto = Window.partitionBy("shard", "__range").orderBy("__mark", "__row").rowsBetween(Window.unboundedPreceding, -1)
    single = rows.join(heavy.select("__mark"), "__mark", "left_anti").withColumn("__w", F.lit(1).cast("bigint"))
    stands = heavy.select("shard", "__range", "__mark", "__w", F.lit(True).alias("__stands"))
    numbered = (single.withColumn("__stands", F.lit(False)).unionByName(stands, allowMissingColumns=True)
                .withColumn("slot", F.coalesce(F.sum("__w").over(upto), F.lit(0)))
                .join(starts, ["shard", "__range"]).withColumn("slot", F.col("slot") + F.col("__start")))
    parts = rows.join(heavy.select("__mark", "__w"), "__mark").withColumn(
        "__part", F.pmod(F.xxhash64("__row"), F.ceil(F.col("__w") / slot_rows)))
    sizes = parts.groupBy("__mark", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__mark").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    first = numbered.where("__stands").select("__mark", F.col("slot").alias("__first"))
    within = F.row_number().over(Window.partitionBy("__mark", "__part").orderBy("__row")) - 1
    copies = (parts.withColumn("__at", within).join(sizes, ["__mark", "__part"]).join(first, "__mark")
              .withColumn("slot", F.col("__first") + F.col("__before") + F.col("__at")))
    keep = [*rows.columns, "slot"]
    return numbered.where("not __stands").select(keep).unionByName(copies.select(keep))


def assign(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None, id_column: str = "doc_id", text_column: str = "text",
           carry: bool = True, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Every row of `docs` with its place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `tree` decides the shard, `grown` (by default the tree with one more shard in a region of its own) `grown_shard`. The law is
    `key`: the id and the tree decide, so rows of one id stay together and equal texts of different ids do not. `slot`
    numbers the rows of a shard by a hash of id, size and text checksum. With `carry` the input row follows as the struct
    `document`, so columns of any name are kept apart.

    A null text has no bytes (size 16, checksum 0); null ids share the key "null"; rows alike in id and text are placed
    together and numbered apart; an empty table gives an empty result. Rows are narrow unless carried: the texts are
    read once and not shuffled. The measured rows are written once, so a lost executor cannot change their numbering.
    """
    tree = tree or layout()
    grown = grown or layout(added=1)
    text = text_of(text_column).cast("binary")
    document = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if carry else []
    key = key_of(id_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), key.alias("__key"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), *document)
    rows = rows.select(
        "doc_id", "size", "text_crc32", shard_of(F.col("__key"), tree).alias("shard"), shard_of(F.col("__key"), grown).alias("grown_shard"),
        F.md5(F.concat_ws(":", "__key", F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary")).alias("__mark"),
        F.monotonically_increasing_id().alias("__row"), *[c for c in ["document"] if carry])
    rows = materialize(rows, "shard-rows")
    out = _slots(rows, rows.count(), slot_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *[c for c in ["document"] if carry])


def write_shards(assigned: DataFrame, path: str, files_rows: int = 1_000_000) -> None:
    """Write the carried documents as Parquet, a folder `shard=N` each, rows in the order of their slots within and across its files."""
    chunk = F.floor(F.col("slot") / files_rows)
    rows = assigned.select("shard", "slot", "document").withColumn("__chunk", chunk)
    (rows.repartition("shard", "__chunk").sortWithinPartitions("shard", "slot").drop("__chunk")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
