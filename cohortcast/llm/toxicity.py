"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Both classes have a model of the next letter given the ones before it in the word. They share their lower
orders: a letter's continuation counts are taken over both classes together, so an expression that is rare or
new in a class is smoothed by the same shared counts, and evidence comes only from what the classes saw differently.
A text's evidence is the toxic minus the ordinary log-likelihood per word; a logistic curve
fitted on labelled rows that the counts have not seen turns it into a score.

The evidence of every n-gram and context stays a table that grows with the corpus. Tasks hold only that of the `HOT` most
frequent n-grams; a word with any other n-gram is looked up in the tables by joins, once per distinct word. Evidence is
counted in whole `UNIT`s, so sums are the same whichever way and order they are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortcast.llm.common import crc_bucket, map_texts, text_of, whole_rows
from cohortcast.session import materialize

ORDER = 5
DISCOUNT = 0.75
MARGIN = 3.0
UNIT = 1 << 20
HOT = 1 << 16
CALIBRATION_ROWS = 20_000
CALIBRATION_PART = 5  # one in so many training rows fits the curve instead of the counts
THRESHOLD = 0.3
DEFAULT_CURVE = (-4.3, 0.0, 37.0)  # where the calibration rows lack a class
GRAMS_HELD = 1_000_000
SEGMENT = 2_000_000
SPACE = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Grams:
    """Hashed letter events of a stretch: whole n-gram, its context, last three letters, last two before the letter, letter, place."""
    part: str = field(repr=False)
    doc: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    triple: np.ndarray
    pair: np.ndarray
    letter: np.ndarray
    ends: np.ndarray = field(repr=False)
    at: np.ndarray = field(repr=False)


def letter_events(texts: list[str]) -> Iterator[Grams]:
    """Events of all letters and word ends of `texts`, in stretches of bounded size; words are runs of letters (one longer than a stretch is several)."""
    joined = "".join(" " + t.lower() for t in texts) + " "
    starts = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])[:-1]
    at = 0
    while at < len(joined):
        end = at + SEGMENT
        if end < len(joined):
            cut = joined.rfind(" ", at + 1, end)
            end = cut + 1 if cut > at else end
        lead = " " * (joined[at] != " ")
        yield _events(lead + joined[at:end] + " " * (joined[end - 1:end] != " " and end < len(joined)), at - len(lead), starts)
        # the blank that ends a stretch also starts the next one
        at = end - 1 if end < len(joined) and joined[end - 1] == " " else end


def _events(part: str, offset: int, starts: np.ndarray) -> Grams:
    raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[raw]
    codes = np.where(letter, raw, SPACE).astype(np.uint64)
    index = np.arange(len(codes))
    depth = index - np.maximum.accumulate(np.where(letter, -1, index))
    before = np.zeros(len(codes), np.int64)
    before[1:] = depth[:-1]
    at = np.flatnonzero(letter | (before > 0))
    reach = np.minimum(before[at] + 1, at)
    gram = codes[at] + np.uint64(1)
    context = np.full(len(at), 7, np.uint64)
    triple, pair = gram, context
    for k in range(1, ORDER):
        back = codes[np.maximum(at - k, 0)] + np.uint64(3)
        within = k <= reach
        gram = np.where(within, gram * _MUL + back, gram)
        context = np.where(within, context * _MUL + back, context)
        if k == 2:
            triple, pair = gram, context
    ends = ~letter[at]
    doc = np.searchsorted(starts, at + offset - ends, "right") - 1  # a word end belongs to its last letter's text
    return Grams(part, doc, _finish(gram), _finish(context), _finish(triple), _finish(pair), codes[at], ends, at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of (text, label) rows with their counts by class, combined within the partition."""
    names = ["gram", "context", "triple", "pair", "letter"]
    held: list[pd.DataFrame] = []
    size = 0

    def combined() -> pd.DataFrame:
        return pd.concat(held).groupby("gram", sort=False).agg(
            {**{n: "first" for n in names[1:]}, "toxic": "sum", "ordinary": "sum"}).reset_index()

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            labels = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for g in letter_events(part.column(0).to_pylist()):
                values, first, inverse = np.unique(g.gram, return_index=True, return_inverse=True)
                toxic = np.bincount(inverse, weights=labels[g.doc], minlength=len(values)).astype(np.int64)
                total = np.bincount(inverse, minlength=len(values))
                held.append(pd.DataFrame({n: getattr(g, n)[first].view(np.int64) for n in names} | {"toxic": toxic, "ordinary": total - toxic}))
                size += len(values)
            if size > 2 * GRAMS_HELD:
                held = [combined()]
                size = len(held[0])
                if size > GRAMS_HELD:
                    yield pa.RecordBatch.from_pandas(held[0], preserve_index=False)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pandas(combined(), preserve_index=False)


GRAM_SCHEMA = "gram bigint, context bigint, triple bigint, pair bigint, letter bigint, toxic bigint, ordinary bigint"


@dataclass(frozen=True)
class Hot:
    """Sorted keys and evidence of the most frequent n-grams; if they are all there are (`whole`), of all contexts too."""
    grams: np.ndarray
    gram_evidence: np.ndarray
    contexts: np.ndarray
    context_evidence: np.ndarray
    whole: bool

    def look_up(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of every event, and which of them only the tables can tell."""
        value, known = _found(self.grams, self.gram_evidence, g.gram)
        if self.whole:
            new = np.flatnonzero(~known)
            value[new] = _found(self.contexts, self.context_evidence, g.context[new])[0]
            known[:] = True
        return value, ~known

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, dict[tuple[int, str], int]]:
        """Per text: words, summed evidence of its words and the sum of it beyond `MARGIN`; and how often each text has a word left to the tables."""
        out = np.zeros((len(texts), 3), np.int64)
        left: dict[tuple[int, str], int] = {}
        for g in letter_events(texts):
            last = np.flatnonzero(g.ends)
            if not len(last):
                continue
            first = np.concatenate([[0], last[:-1] + 1])
            value, unsure = self.look_up(g)
            word, doc, unsure = np.add.reduceat(value, first), g.doc[last], np.logical_or.reduceat(unsure, first)
            np.add.at(out[:, 0], doc, 1)
            sure = ~unsure
            np.add.at(out[:, 1], doc[sure], word[sure])
            np.add.at(out[:, 2], doc[sure], beyond(word[sure]))
            for i in np.flatnonzero(unsure):
                key = int(doc[i]), g.part[g.at[first[i]]:g.at[last[i]]]
                left[key] = left.get(key, 0) + 1
        return out, left


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    distinct, inverse = np.unique(wanted.view(np.int64), return_inverse=True)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    known = keys[at] == distinct
    return np.where(known, values[at], 0)[inverse], known[inverse]


def beyond(word: np.ndarray) -> np.ndarray:
    return np.maximum(word - int(MARGIN * UNIT), 0)


@dataclass(frozen=True)
class Model:
    """Tables (key, evidence) of all n-grams and all contexts, what tasks hold of them, and the fitted curve."""
    grams: DataFrame
    contexts: DataFrame
    hot: Hot
    curve: tuple[float, ...] = DEFAULT_CURVE

    def score(self, texts: list[str]) -> np.ndarray:
        if self.hot.whole:
            return _curve(features(self.hot.evidence(texts)[0]), self.curve)
        docs = self.grams.sparkSession.createDataFrame(list(enumerate(texts)), "at bigint, text string")
        rows = measured(docs, ["at"], self).toArrow()
        out = np.zeros((len(texts), 3), np.int64)
        out[rows["at"].to_numpy()] = np.stack([rows[c].to_numpy() for c in ("words", "total", "beyond")], 1)
        return _curve(features(out), self.curve)


def features(evidence: np.ndarray) -> np.ndarray:
    """Constant and the two length-normalised sums; a text without words has none."""
    n = np.maximum(evidence[:, :1], 1)
    return np.concatenate([np.ones((len(evidence), 1)), evidence[:, 1:] / UNIT / n], 1)


def _curve(x: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights), -35, 35)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge, so separable rows give finite weights."""
    scale = np.maximum(np.abs(x).max(0, initial=1e-9), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - y) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Count, smooth and calibrate on the labelled rows of `docs` outside the held-out quarter.

    Labels are `doc_id` and `toxic`; null ids or labels are ignored and a document is toxic if any of its labels is.
    Labels grow with the corpus, so they meet the texts in a sort-merge join at every size.
    Counts cover every training row and grow with them; they are smoothed as tables, and all of them score. What reaches the
    driver is bounded: a copy of the `HOT` most frequent n-grams' evidence and `CALIBRATION_ROWS` rows of evidence.
    Returns None unless both classes have training rows.
    """
    said = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("__id"))
            .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")).hint("merge"))
    training = (docs.select(F.col("doc_id").cast("bigint").alias("__id"), text_of().alias("text"))
                .where(crc_bucket(F.col("__id"), 4) != 2))
    part = F.pmod(F.xxhash64("__id"), F.lit(CALIBRATION_PART))
    counted = training.where(part != 0).join(said, "__id").select("text", "label")
    first = [F.first(c).alias(c) for c in ("context", "triple", "pair", "letter")]
    grams = materialize(counted.mapInArrow(_counted, GRAM_SCHEMA).groupBy("gram").agg(
        *first, F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-grams")
    total = grams.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).first()
    if not total["t"] or not total["o"]:
        return None
    known, contexts = (materialize(t, "toxicity-evidence") for t in _smoothed(grams, total["n"]))
    whole = total["n"] <= HOT
    most = known.orderBy(F.desc("weight"), "key").limit(HOT)
    model = Model(known, contexts, Hot(*_arrays(known if whole else most), *_arrays(contexts if whole else contexts.limit(0)), whole))
    order = F.xxhash64("__id", F.lit(1))
    sample = (training.where(part == 0).join(said, "__id").select(order.alias("rank"), F.xxhash64("text").alias("tie"), "text", "label"))
    rows = measured(sample, ["rank", "tie", "label"], model).orderBy("rank", "tie").limit(CALIBRATION_ROWS).toArrow()
    y = rows["label"].to_numpy()
    if 0 < y.sum() < len(y):
        x = features(np.stack([rows[c].to_numpy() for c in ("words", "total", "beyond")], 1))
        model = replace(model, curve=fit_curve(x, y))
    return model


def measured(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """`keep` and words, total, beyond (see `Hot.evidence`) per row of `docs`, which has a `text` without nulls.

    Texts give their words of unheld n-grams. Those are reduced to distinct words, whose n-grams meet the evidence tables, and
    each distinct text adds up its words' evidence. Only small rows are shuffled, never texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)
    n = len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, left = shared.value.evidence(batch.column(n + 1).to_pylist())
        items: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for (doc, word), count in left.items():
            items[doc].append({"word": word, "n": count})
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), *(pa.array(out[:, i]) for i in range(3)),
                                           pa.array(items, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))],
                                          names=[*keep, "__text", "words", "total", "beyond", "left"])

    source = docs.select(*keep, F.xxhash64("text").alias("__text"), "text")
    schema = StructType([*source.schema.fields[:n + 1], *_parse("words bigint, total bigint, beyond bigint, left array<struct<word: string, n: bigint>>")])
    rows = map_texts(source, source.columns, schema, run)
    if model.hot.whole:
        return rows.select(*keep, "words", "total", "beyond")
    rows = materialize(rows, "toxicity-words")
    left = rows.where(F.size("left") > 0).select("__text", F.inline("left")).select("__text", F.xxhash64("word").alias("id"), "word", "n")
    found = materialize(_word_evidence(left.groupBy("id").agg(F.first("word").alias("word")), model, shared), "toxicity-found")
    beyond_ = F.greatest(F.col("evidence") - F.lit(int(MARGIN * UNIT)), F.lit(0))
    more = (left.groupBy("__text", "id").agg(F.max("n").alias("n")).join(found, "id").groupBy("__text")
            .agg(F.sum(F.col("n") * F.col("evidence")).alias("__total"), F.sum(F.col("n") * beyond_).alias("__beyond")))
    added = [(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("total", "beyond")]
    return rows.drop("left").join(more, "__text", "left").select(*keep, "words", *added)


def _word_evidence(words: DataFrame, model: Model, shared) -> DataFrame:
    """(id, evidence) of every word of (id, word): of each n-gram its own evidence, else its context's, else none."""
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                held = np.zeros(len(ids), np.int64)
                open_ = []
                for g in letter_events(texts):
                    value, unsure = shared.value.look_up(g)
                    np.add.at(held, g.doc, value)
                    open_.append(pd.DataFrame({"doc": g.doc, "gram": g.gram.view(np.int64), "context": g.context.view(np.int64)})[unsure])
                counted = pd.concat(open_).groupby(["doc", "gram", "context"], sort=False).size().reset_index(name="n")
                yield pa.RecordBatch.from_arrays([pa.array(ids[counted["doc"]]), pa.array(held[counted["doc"]]), *(pa.array(counted[c].to_numpy(), pa.int64()) for c in ("gram", "context", "n"))],
                                                 names=["id", "held", "gram", "context", "n"])

    rows = words.mapInArrow(events, "id bigint, held bigint, gram bigint, context bigint, n bigint")
    own = model.grams.select(F.col("key").alias("gram"), F.col("evidence").alias("own"))
    fallback = model.contexts.select(F.col("key").alias("context"), F.col("evidence").alias("fallback"))
    each = F.coalesce("own", "fallback", F.lit(0))
    return (rows.join(own, "gram", "left").join(fallback, "context", "left")
            .groupBy("id").agg((F.max("held") + F.sum(F.col("n") * each)).alias("evidence")))


def _parse(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _smoothed(grams: DataFrame, n_grams: int) -> tuple[DataFrame, DataFrame]:
    """(key, evidence, weight) of every n-gram and (key, evidence) of every context, for letters new in it.

    Kneser-Ney from below: letters by the n-grams they end, letter triples by the n-grams they end given the pair
    before, then all counts of both classes, and only the last step has the counts of one class.
    """
    d = F.lit(DISCOUNT)
    triples = grams.groupBy("triple", "pair", "letter").agg(F.count("*").alias("n3"))
    pairs = triples.groupBy("pair").agg(F.sum("n3").alias("n2"), F.count("*").alias("t2"))
    letters = grams.groupBy("letter").agg((F.count("*") / F.lit(n_grams)).alias("p1"))
    low = triples.join(pairs, "pair").join(letters, "letter").select(
        "triple", "pair", ((F.greatest(F.col("n3") - d, F.lit(0.0)) + d * F.col("t2") * F.col("p1")) / F.col("n2")).alias("p3"))
    contexts = grams.groupBy("context").agg(
        F.sum("toxic").alias("ct"), F.sum("ordinary").alias("co"), F.count_if(F.col("toxic") > 0).alias("tt"),
        F.count_if(F.col("ordinary") > 0).alias("to"), F.count("*").alias("types"))
    both = F.col("toxic") + F.col("ordinary")
    shared = (F.greatest(both - d, F.lit(0.0)) + d * F.col("types") * F.col("p3")) / (F.col("ct") + F.col("co"))
    rows = grams.join(contexts, "context").join(low, ["triple", "pair"]).withColumn("ps", shared)

    def chance(count: str, seen: str, types: str):
        own = (F.greatest(F.col(count) - d, F.lit(0.0)) + d * F.col(types) * F.col("ps")) / F.col(seen)
        return F.when(F.col(seen) > 0, own).otherwise(F.col("ps"))

    def backoff(seen: str, types: str):
        return F.when(F.col(seen) > 0, d * F.col(types) / F.col(seen)).otherwise(1.0)

    evidence = F.log(chance("toxic", "ct", "tt")) - F.log(chance("ordinary", "co", "to"))
    new = F.log(backoff("ct", "tt")) - F.log(backoff("co", "to"))
    return (rows.select(F.col("gram").alias("key"), F.round(evidence * UNIT).cast("bigint").alias("evidence"), both.alias("weight")),
            contexts.select(F.col("context").alias("key"), F.round(new * UNIT).cast("bigint").alias("evidence")))


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.select("key", "evidence").toArrow()
    keys, evidence = rows["key"].to_numpy(), rows["evidence"].to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.int64), evidence[order].astype(np.int64)


def _score(curve: tuple[float, ...]) -> Column:
    words = F.greatest("words", F.lit(1))
    line = F.lit(curve[0]) + F.lit(curve[1]) * (F.col("total") / UNIT / words) + F.lit(curve[2]) * (F.col("beyond") / UNIT / words)
    return 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(35.0)), F.lit(-35.0))))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) per input row; without a model every score is 0.

    A null or blank text has no evidence and gets the curve's base score. A null doc_id stays null, repeated
    rows give repeated results, other columns are ignored, an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("score"))
    return measured(source, ["doc_id"], model).select("doc_id", _score(model.curve).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`, learned from `labels` as `fit` says.

    held_out is false for a null doc_id.
    """
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more; all columns pass through, whatever their names.

    Without a model, as when the labels lack a class, all rows stay. A null text is an empty one, repeated rows
    stay or go together, and an empty table gives an empty result.
    """
    if model is None:
        return docs
    if model.hot.whole:
        shared, curve = docs.sparkSession.sparkContext.broadcast(model.hot), model.curve
        at = docs.columns.index("text")

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            return batch.filter(pa.array(_curve(features(shared.value.evidence(texts)[0]), curve) < threshold))

        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Arrow functions take no names with dots
        return map_texts(plain, plain.columns, plain.schema, rows).toDF(*docs.columns)
    key = F.xxhash64(text_of())
    rejected = (measured(docs.select(key.alias("__key"), text_of().alias("text")), ["__key"], model)
                .where(_score(model.curve) >= threshold).select("__key").distinct())
    return whole_rows(docs, key.alias("__key")).join(rejected, "__key", "left_anti").select("__row.*")
