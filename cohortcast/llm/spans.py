"""Substring dedup over sliding sentence spans.

From every sentence on, the run of `SENTENCES` consecutive ones, or as many more as it takes to hold `LEAST_WORDS`
words, is hashed, and so is the run of two that hold more than `LONGEST` words; equal hashes are joined over the whole corpus,
and the sentences of every occurrence but the first are removed. Occurrences are ordered by doc_id (null last), text hash and position.
A sentence longer than `LONGEST` words counts as several, cut before the words whose hash is least among `WINDOW` neighbours,
so the cuts are the same wherever a passage starts. A passage of more than 3 * `LONGEST` words holds a run at any offset in its
sentences, one of more than 2 * `LONGEST` does between sentence borders or within long sentences; of shorter ones in short
sentences that it starts or ends inside, those at the ends may hide the rest. A repeated line of one or two sentences of up to
`LONGEST` words in all is left alone.

Many texts are segmented and hashed at once, as arrays over their words; a run's hash comes from sums of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import TEXTS_PER_BATCH, text_of
from cohortcast.session import materialize

SENTENCES = 3
LEAST_WORDS = 12
LONGEST = 25
WINDOW = 9
HOT_SHARE = 1000           # a hash with more than one of so many rows is hot; there are at most so many of those
BATCH_BYTES = 1 << 21
COUNT_AT = -1              # the row of a text that carries its number of sentences instead of a run

POWER_TABLE = 1 << 16
_RANDOM = np.random.default_rng(7)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES[[9, 10, 11, 12, 13, 32]] = 0
BYTE_POWERS = np.multiply.accumulate(np.full(POWER_TABLE, 0x9E3779B97F4A7C15, np.uint64))
WORD_FACTOR = 0xD6E8FEB86659FD93
WORD_INVERSE = pow(WORD_FACTOR, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of several texts: their byte ranges in the texts joined by line ends, their text, and whether a sentence begins there."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def words_of(texts: Sequence[bytes]) -> Words:
    """A sentence ends with a word that ends in a mark, and at a line end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = np.concatenate([[True], (data - np.uint8(9) <= 4) | (data == 32)])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    begins = np.ones(len(starts), bool)
    if len(starts):
        lines = np.flatnonzero(data == 10)
        newline = np.searchsorted(lines, ends[:-1]) < np.searchsorted(lines, starts[1:])
        begins[1:] = newline | ((last == 46) | (last == 33) | (last == 63))[:-1]
    return Words(starts, ends, np.searchsorted(offsets, starts, "right") - 1, begins, data, offsets)


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes; the work arrays are bounded unless one word is longer than a batch."""
    out, at = np.zeros(len(words.starts), np.uint64), 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(words.ends, words.starts[at] + BATCH_BYTES)))
        begin = words.starts[at]
        first = words.starts[at:stop] - begin
        part = words.data[begin:words.ends[stop - 1]]
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
        value = BYTE_VALUES[part] * BYTE_POWERS[place % POWER_TABLE]
        if len(part) > POWER_TABLE:
            value *= (2 * (place // POWER_TABLE) + 1).astype(np.uint64)
        out[at:stop] = mixed(np.add.reduceat(value, first))
        at = stop
    return out


def pieces(words: Words, hashes: np.ndarray) -> np.ndarray:
    """First words of all sentences, those longer than `LONGEST` words cut before the words with the least hash of some window
    of `WINDOW` words after the first, the last such of equals."""
    first = np.flatnonzero(words.begins)
    sizes = np.diff(np.append(first, len(hashes)))
    long = sizes > LONGEST
    windows = sizes[long] - WINDOW
    at = np.repeat(first[long] + 1, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    best, least = at.copy(), hashes[at]
    for k in range(1, WINDOW):
        other = hashes[at + k]
        nearer = other <= least
        best[nearer], least[nearer] = at[nearer] + k, other[nearer]
    return np.union1d(first, best)


def runs(first: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, first, last) sentence of every run: kind 0 from `SENTENCES` on, kind 1 of two long ones. Runs stay within their text."""
    n = len(first)
    each = np.arange(n)
    reach = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends = np.maximum(np.searchsorted(reach, reach[:-1] + LEAST_WORDS) - 1, each + SENTENCES - 1)
    inside = ends < n
    inside[inside] = text[ends[inside]] == text[each[inside]]
    pair = np.flatnonzero((sizes[:-1] + sizes[1:] > LONGEST) & (text[:-1] == text[1:])) if n else each
    return (np.concatenate([np.zeros(inside.sum(), np.int64), np.ones(len(pair), np.int64)]), np.concatenate([each[inside], pair]),
            np.concatenate([ends[inside], pair + 1]))


def _texts(texts: Sequence[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def span_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of every text; then text, number and hash of all runs, a run's number being twice its first sentence plus its kind.

    Hashes are on lower-case words; a run's words w0, w1, ... give the sum of w_i * WORD_FACTOR^i, mixed with their number.
    """
    words = words_of(_texts([t.lower() for t in texts]))
    hashes = word_hashes(words)
    first = pieces(words, hashes)
    text = words.text[first]
    counts = np.bincount(text, minlength=len(texts))
    kind, start, end = runs(first, np.diff(np.append(first, len(hashes))), text)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), f, np.uint64)])) for f in (WORD_FACTOR, WORD_INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * up[:-1])])
    low, high = first[start], np.append(first, len(hashes))[end + 1]
    spans = mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
    number = 2 * (start - (np.cumsum(counts) - counts)[text[start]]) + kind
    return counts, text[start], number.astype(np.int32), spans.view(np.int64)


def batches_of(texts: Sequence[str]) -> Iterator[slice]:
    """Slices of about `BATCH_BYTES` characters, a longer text on its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BATCH_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _spans(docs: DataFrame) -> DataFrame:
    """Every run of every text, and for each text a row at `COUNT_AT` with its number of sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
                part = batch.slice(at, TEXTS_PER_BATCH)
                texts = part.column(2).to_pylist()
                for some in batches_of(texts):
                    counts, text, number, span = span_hashes(texts[some])
                    own = np.arange(some.start, some.stop)
                    rows = pa.array(np.concatenate([own, text + some.start]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate([np.full(len(own), COUNT_AT, np.int32), number])),
                         pa.array(np.concatenate([counts, span]))], names=["id", "text_hash", "at", "span"])

    return docs.mapInArrow(run, "id bigint, text_hash bigint, at int, span bigint")


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"), F.col("at").alias("at"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Every document without its repeated passages.

    Input needs `doc_id` and `text`; other columns are ignored. Output, one row per input row: doc_id, text
    (without the removed sentences and the blanks after them), n_sentences, n_removed. A null text stays
    null with no sentences; rows equal in doc_id and text are one document, so none of them is the other's repeat; a
    null doc_id comes last in the order of occurrences; an empty table gives an empty result.

    Counting a hash is pre-aggregated, and only hashes that occur more than once are joined back: those with more than one
    row in `HOT_SHARE`, of which there are at most `HOT_SHARE`, from a broadcast, so that no task gets all rows of one, the others by a shuffle.
    Only texts with repeats are segmented again.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_of()).alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = materialize(_spans(source.withColumn("text", text_of())), "sentence-spans")
    spans = rows.where(F.col("at") != COUNT_AT)
    repeated = spans.groupBy("span").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).where("n > 1")
    firsts = materialize(repeated, "repeated-spans")
    hot = F.col("n") * HOT_SHARE > rows.count()
    common = F.broadcast(firsts.where(hot).select("span", "first"))
    repeats = (spans.join(common, "span").where(_order() != F.col("first")).select("id", "text_hash", "at")
               .union(spans.join(common, "span", "left_anti").join(firsts.where(~hot), "span").where(_order() != F.col("first")).select("id", "text_hash", "at")))
    counted = rows.where(F.col("at") == COUNT_AT).select("id", "text_hash", F.lit(None).cast("int").alias("at"), F.col("span").alias("n_sentences"))
    found = (repeats.withColumn("n_sentences", F.lit(None).cast("bigint")).union(counted).groupBy(_key("id"), "text_hash")
             .agg(F.collect_set("at").alias("hits"), F.max("n_sentences").alias("n_sentences")))
    joined = source.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("none"))).join(found, ["key", "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
                part = batch.slice(at, TEXTS_PER_BATCH)
                removed, texts = np.zeros(part.num_rows, np.int64), part.column(1)
                hits = part.column(2).to_pylist()
                touched = [i for i, h in enumerate(hits) if h]
                if touched:
                    new = texts.to_pylist()
                    for i in touched:
                        new[i], removed[i] = without(new[i], hits[i])
                    texts = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, part.column(3), pa.array(removed)], names=["doc_id", "text", "n_sentences", "n_removed"])

    return joined.select("id", "text", "hits", "n_sentences").mapInArrow(cut, "doc_id bigint, text string, n_sentences bigint, n_removed bigint")


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("key")


def without(text: str, hits: Sequence[int]) -> tuple[str, int]:
    """Text without the sentences covered by the runs of these numbers, and how many they are."""
    low = words_of(_texts([text.lower()]))
    first = pieces(low, word_hashes(low))
    kind, start, end = runs(first, np.diff(np.append(first, len(low.starts))), low.text[first])
    gone = np.zeros(len(first) + 1, np.int64)
    chosen = np.isin(2 * start + kind, hits)
    np.add.at(gone, start[chosen], 1)
    np.add.at(gone, end[chosen] + 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    data = text.encode("utf-8", "surrogatepass")
    borders = np.append(words_of([data]).starts[first], len(data))  # lower case moves bytes, not words
    kept = [data[:borders[0]], *(data[borders[i]:borders[i + 1]] for i in np.flatnonzero(~gone))]
    return b"".join(kept).decode("utf-8", "surrogatepass"), int(gone.sum())
