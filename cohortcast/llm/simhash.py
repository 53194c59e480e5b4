"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at three or fewer differing bits. The 64 bits are cut into three chunks. A linked
pair differs in a chunk, and leaving that chunk out leaves at most two differing bits, so the pair
meets where each side changes at most one of the other bits: half the remaining radius. Every
distinct fingerprint therefore emits, for each chunk left out, itself and its variants with one other
bit changed (131 rows instead of the 2,146 that whole balls of radius one and two would take), and
the rows are shuffled on (chunk, variant).

Rows that meet are not paired with each other. Two that agree in the left-out chunk differ in at most
two bits, two that differ in one bit of it in at most three, so each run of equal chunk values is
linked to its first member, and runs one bit apart are linked by their first members. Pairs that
differ in one chunk alone meet unchanged and are found by a ball search on that chunk. This gives the same
components as all pairs with work linear in the group, and every link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import map_texts, text_of, whole_rows
from cohortcast.llm.components import components
from cohortcast.session import materialize

RADIUS = 3
CHUNKS = ((0, 21), (21, 22), (43, 21))  # (lowest bit, bits)
WIDEST = 22
SHINGLES_AT_ONCE = 1 << 15

_shingle_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str) -> int:
    """64-bit SimHash of 3-word shingles of the text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words)]
        total = 1
    else:
        total = len(words) - 2
    ones = np.zeros(64, np.int64)
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = words[at:at + SHINGLES_AT_ONCE + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) > 1 else part
        hashes = np.fromiter(map(_shingle_hash, shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) per row of `docs`, the fingerprint as a signed 64-bit number; null text counts as empty."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return map_texts(source, source.columns, "doc_id bigint, text_hash bigint, fp bigint", rows)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def variants(nodes: DataFrame) -> DataFrame:
    """(chunk, variant, fp): `fp` without a chunk, unchanged and with one of the other bits changed."""
    changes = []
    for number, (low, bits) in enumerate(CHUNKS):
        chunk = ((1 << bits) - 1) << low
        keep = ~chunk & ((1 << 64) - 1)
        for flip in [0, *(1 << b for b in range(64) if not chunk >> b & 1)]:
            changes.append(F.struct(F.lit(number).cast("tinyint").alias("chunk"), F.lit(_signed(keep)).alias("keep"),
                                    F.lit(_signed(flip)).alias("flip")))
    return nodes.select("fp", F.explode(F.array(*changes)).alias("c")).select(
        F.col("c.chunk").alias("chunk"), F.col("fp").bitwiseAND(F.col("c.keep")).bitwiseXOR(F.col("c.flip")).alias("variant"), "fp")


_LOW = np.array([c[0] for c in CHUNKS], np.uint64)
_MASK = np.array([(1 << c[1]) - 1 for c in CHUNKS], np.uint64)


def _links(chunk: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by (variant, chunk)."""
    new = np.ones(len(fp), bool)
    new[1:] = (variant[1:] != variant[:-1]) | (chunk[1:] != chunk[:-1])
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    chunk, variant, fp, group = chunk[shared], variant[shared], fp[shared], group[shared]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    if len(fp):
        value = ((fp >> _LOW[chunk]) & _MASK[chunk]).astype(np.int64)
        place = (group.astype(np.int64) << WIDEST) | value
        order = np.lexsort((fp, place))
        place, fp, chunk, variant = place[order], fp[order], chunk[order], variant[order]
        points, first, run = np.unique(place, return_index=True, return_inverse=True)
        head = fp[first]
        left.append(fp), right.append(head[run])
        for bit in range(WIDEST):
            other = points ^ (1 << bit)
            at = np.minimum(np.searchsorted(points, other), len(points) - 1)
            met = (points[at] == other) & (points < other)
            left.append(head[met]), right.append(head[at[met]])
        whole = (fp & ~(_MASK[chunk] << _LOW[chunk])) == variant
        of_group = place >> WIDEST
        numbers, times = np.unique(of_group[whole], return_counts=True)
        whole &= np.isin(of_group, numbers[times > 1])
        if whole.any():
            spot, own = np.unique(place[whole], return_index=True)
            own = fp[whole][own]
            ball = np.concatenate([spot, *(spot ^ (1 << b) for b in range(WIDEST))])
            center = np.tile(own, WIDEST + 1)
            order = np.argsort(ball, kind="stable")
            ball, center = ball[order], center[order]
            for b in range(WIDEST):
                for c in range(b):
                    other = spot ^ ((1 << b) | (1 << c))
                    start, end = np.searchsorted(ball, other), np.searchsorted(ball, other, "right")
                    for shift in range(int((end - start).max(initial=0))):  # a point lies in at most WIDEST + 1 balls
                        met = start + shift < end
                        left.append(own[met]), right.append(center[start[met] + shift])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    far = np.bitwise_count(a ^ b)
    good = (far > 0) & (far <= RADIUS)
    pairs = np.unique(np.stack([np.minimum(a[good], b[good]), np.maximum(a[good], b[good])]), axis=1)
    return pairs[0], pairs[1]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (variant, chunk); a group may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(parts):
        chunk, variant, fp = (np.concatenate([p[i] for p in parts]) for i in range(3))
        a, b = _links(chunk.astype(np.int64), variant.view(np.uint64), fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, variant, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        same = (variant == variant[-1]) & (chunk == chunk[-1])
        cut = len(fp) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and (held[-1][1][-1], held[-1][0][-1]) == (variant[-1], chunk[-1]):
            held.append((chunk, variant, fp))
            continue
        done = [*held, (chunk[:cut], variant[:cut], fp[:cut])]
        held = [(chunk[cut:], variant[cut:], fp[cut:])]
        if sum(len(p[2]) for p in done):
            yield out(done)
    if held:
        yield out(held)


def _components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of a table of (doc_id, fp): every distinct fingerprint once."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "fingerprint-nodes")
    met = variants(nodes).repartition("chunk", "variant").sortWithinPartitions("variant", "chunk")
    roots = components(met.mapInArrow(_link_groups, "a bigint, b bigint").distinct())
    members = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "low_id")
    lowest = members.groupBy("root").agg(F.min("low_id").alias("component"))
    linked = members.join(lowest, "root").select("fp", "root", "component")
    return nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("component")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """SimHash fingerprint and component of every document.

    Input needs `doc_id` and `text`; other columns are ignored. Output, one row per input row: doc_id,
    fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links
    of at most three differing bits, itself included. Null and blank texts have fingerprint zero and
    link like any other. A null doc_id never names a component; a component of null ids only has none.
    Repeated rows give repeated results, an empty table an empty result.

    Exact copies share a fingerprint and become one node by a pre-aggregated minimum, so a group of copies
    costs one node however large. Fingerprints and links stay in tables.
    """
    prints = materialize(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    return prints.join(_components(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that of its smallest doc_id, smallest text hash on a tie.

    A null doc_id comes last, so such a row stays only where no row of its component has an id. Rows
    equal in doc_id and text are one document. The columns are those of `docs`, whatever their names;
    an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text_hash"))
    keepers = (prints.join(_components(prints), "fp").groupBy("root").agg(F.min(rank).alias("best"))
               .select(_id_key(F.col("best.id")).alias("__id"), F.col("best.text_hash").alias("__text")))
    keyed = whole_rows(docs, _id_key(F.col("doc_id")).alias("__id"), F.xxhash64(text_of()).alias("__text"))
    return keyed.join(keepers, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select("__row.*")


def _id_key(doc_id):
    return F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("none"))
