"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its letter pairs and triples, taken per word and hashed into `BUCKETS` rows.
Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded,
stratified sample. As the average is linear, embedding times softmax gives one small table of
class weights per bucket for prediction. A temperature fitted on rows the descent has not seen calibrates the
probabilities, and a text whose calibrated probability is below the level that the given
share of those rows falls under is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.llm.common import crc_bucket, map_texts, text_of
from cohortcast.llm.toxicity import _letters

BUCKETS = 1 << 14
WIDTH = 16
ROWS_PER_LANGUAGE = 600      # bound of the training sample, texts of each language
VALIDATION_PART = 5          # one sampled text in so many calibrates
EPOCHS = 12
RATE = 0.5
REJECT_SHARE = 0.005
SEGMENT = 2_000_000
UNKNOWN = "und"
SPACE = 32


def subword_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the letter pairs and triples of the whole text, and their counts; words are runs of letters."""
    counts = np.zeros(BUCKETS, np.int64)
    low = text.lower()
    for at in range(0, len(low), SEGMENT):
        raw = np.frombuffer((" " + low[at:at + SEGMENT] + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[raw]
        codes = np.where(letter, raw, SPACE).astype(np.uint64)
        if not letter.any():
            continue
        pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
        triples = pairs[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] + np.uint64(1)
        for grams, keep in ((pairs, letter[:-1] | letter[1:]), (triples, letter[1:-1])):
            grams = grams[keep] * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((grams >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    """Class weights per bucket (embedding times softmax), bias, temperature and rejection level."""
    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights[buckets] / counts.sum() + self.bias

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether it is rejected; a text without letters is unknown."""
        buckets, counts = subword_buckets(text)
        if not len(buckets) or not self.names:
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(buckets, counts) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best]), bool(p[best] < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], names: tuple[str, ...], seed: int = 5) -> Model:
    """Stochastic gradient descent over (buckets, counts, language, validation) rows, then temperature and rejection level."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    soft, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    learn = [r for r in rows if not r[3]] or rows
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            buckets, counts, label, _ = learn[i]
            share = counts / counts.sum()
            hidden = share @ embed[buckets]
            slope = _softmax(hidden @ soft + bias)
            slope[label] -= 1
            rate = RATE * (1 - done / steps)
            back = soft @ slope
            soft -= rate * np.outer(hidden, slope)
            bias -= rate * slope
            embed[buckets] -= rate * WIDTH * np.outer(share, back)
            done += 1
    model = Model(names, (embed @ soft).astype(np.float64), bias)
    check = [r for r in rows if r[3]] or rows
    z = np.array([model.logits(r[0], r[1]) for r in check])
    y = np.array([r[2] for r in check])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(losses))])
    top = _softmax(z / t).max(1)
    return Model(names, model.weights, bias, t, float(np.quantile(top, REJECT_SHARE)))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Train on at most `rows_per_language` texts of each language, the smallest by a hash, outside the held-out fifth.

    The features of a text are bounded by `BUCKETS`, and only those of the sample reach the driver.
    """
    mark = F.xxhash64("doc_id", "lang", F.lit(3))
    pool = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
            .where(F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), 5) != 0))
            .select("doc_id", "lang", "text", mark.alias("mark"), F.xxhash64("text").alias("tie")))
    ids = pool.select("doc_id", "lang", "mark", "tie")
    chosen = (ids.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "tie")))
              .where(F.col("at") <= rows_per_language).select("mark", "tie").distinct())
    # the marks are at most `rows_per_language` a language, so they go to the texts and not the other way round
    sample = pool.join(F.broadcast(chosen), ["mark", "tie"], "left_semi")

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [subword_buckets(t) for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
             pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["mark", "tie", "lang", "buckets", "counts"])

    got = map_texts(sample, ["mark", "tie", "lang", "text"], "mark bigint, tie bigint, lang string, buckets array<int>, counts array<bigint>",
                    featurise).where(F.size("buckets") > 0).orderBy("mark", "tie").toArrow()
    names = tuple(sorted(set(got["lang"].to_pylist())))
    if not names:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {n: i for i, n in enumerate(names)}
    rows = [(np.array(b), np.array(c, np.float64), number[lang], mark % VALIDATION_PART == 0) for b, c, lang, mark in zip(
        got["buckets"].to_pylist(), got["counts"].to_pylist(), got["lang"].to_pylist(), got["mark"].to_pylist())]
    return train(rows, names)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every text.

    Input needs `doc_id` and `text` (and `lang` to train, when no model is given); other columns are ignored. Output, one
    row per input row: doc_id, held_out, lang_pred, score, rejected. A null text or one without a letter is `und` with
    score 0 and rejected; so is every text where no language could be learned. held_out is false for
    a null doc_id; repeated rows give repeated results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return map_texts(source, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double, rejected boolean", rows).select(
        "doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
