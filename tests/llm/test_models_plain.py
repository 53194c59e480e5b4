"""The toxicity and language models against plain Python: textbook counts, smoothing, features, sample and calibration."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.llm import langid, toxicity
from tests.llm.test_models import SCHEMA, corpus


def words_of(text):
    out = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    return out.split()


def grams_of(word):
    """Each letter and the word's end with up to four characters before it, the blank before the word included."""
    padded = f" {word} "
    return [padded[max(0, i - 4):i + 1] for i in range(1, len(padded))]


def plain_evidence(texts):
    """Kneser-Ney by the book from (text, label) pairs: a function from a gram to its log ratio of toxic and ordinary."""
    d, counts = 0.75, {0: Counter(), 1: Counter()}
    for text, label in texts:
        for w in words_of(text):
            counts[label].update(grams_of(w))
    grams = set(counts[0]) | set(counts[1])
    by_context, by_pair, enders = defaultdict(set), defaultdict(set), Counter(g[-1] for g in grams)
    by_triple = defaultdict(set)
    for g in grams:
        by_context[g[:-1]].add(g)
        by_triple[g[-3:]].add(g)
        by_pair[g[-3:][:-1]].add(g[-3:])

    def p3(triple):
        pair = triple[:-1]
        n2 = sum(len(by_triple[t]) for t in by_pair[pair])
        return (max(len(by_triple[triple]) - d, 0) + d * len(by_pair[pair]) * enders[triple[-1]] / len(grams)) / n2

    def shared(g):
        same = by_context[g[:-1]]
        total = sum(counts[c][x] for c in (0, 1) for x in same)
        return (max(counts[0][g] + counts[1][g] - d, 0) + d * len(same) * p3(g[-3:])) / total

    def chance(c, g):
        seen = [counts[c][x] for x in by_context[g[:-1]] if counts[c][x]]
        return (max(counts[c][g] - d, 0) + d * len(seen) * shared(g)) / sum(seen) if seen else shared(g)

    def backoff(c, context):
        seen = [counts[c][x] for x in by_context[context] if counts[c][x]]
        return d * len(seen) / sum(seen) if seen else 1.0

    def evidence(g):
        if g in grams:
            return math.log(chance(1, g)) - math.log(chance(0, g))
        return math.log(backoff(1, g[:-1])) - math.log(backoff(0, g[:-1])) if g[:-1] in by_context else 0.0

    return evidence


@pytest.mark.parametrize("held", [1 << 16, 50])
def test_toxicity_against_plain_smoothing(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HOT", held)
    rows, labels = corpus(150, seed=8)
    labels = [(i, q, int(t or any(w.startswith("vik") for w in words_of(r[1])))) for (i, q, t), r in zip(labels, rows)]
    docs = spark.createDataFrame(rows + [(5000, "unseenia Éclair, kato\n", "aa", "s", 1, "x", 9, 9), (5001, None, "aa", "s", 1, "x", 9, 9)], SCHEMA).repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"))
    part = {r["doc_id"]: r["part"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.CALIBRATION_PART)).alias("part")).collect()}
    truth = {i: t for i, _, t in labels}
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    evidence = plain_evidence([(r[1], truth[r[0]]) for r in taught if part[r[0]] != 0])
    known = {}

    def sums(text):
        words = words_of(text)
        for w in words:
            if w not in known:
                known[w] = sum(evidence(g) for g in grams_of(w))
        return [len(words), sum(known[w] for w in words), sum(max(known[w] - toxicity.MARGIN, 0) for w in words)]

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r for r in toxicity.measured(texts, ["doc_id"], model).collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == 152
    for r in texts.collect():
        n, total, beyond = sums(r["text"])
        mine = got[r["doc_id"]]
        assert mine["words"] == n and [mine["total"] / toxicity.UNIT, mine["beyond"] / toxicity.UNIT] == pytest.approx([total, beyond], abs=1e-3)
        line = np.dot(model.curve, [1, total / max(n, 1), beyond / max(n, 1)])
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, line)))), abs=1e-3)

    calibrating = [r for r in taught if part[r[0]] == 0]
    x = np.array([[1, s[1] / max(s[0], 1), s[2] / max(s[0], 1)] for s in (sums(r[1]) for r in calibrating)])
    y = np.array([truth[r[0]] for r in calibrating])
    assert 0 < y.sum() < len(y)
    scale = np.abs(x).max(0)
    slope = (x / scale).T @ (1 / (1 + np.exp(-x @ np.array(model.curve))) - y) + 1e-3 * np.array(model.curve) * scale
    assert np.abs(slope).max() < 1e-3  # the curve is the optimum of the logistic loss on the calibration rows


def plain_buckets(text):
    """Counts of hashed letter pairs and triples by Python's own integers."""
    chars = [" ", *(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()), " "]
    out, mask = Counter(), (1 << 64) - 1
    for i in range(len(chars) - 1):
        pair = (ord(chars[i]) * 0x9E3779B97F4A7C15 + ord(chars[i + 1])) & mask
        if chars[i] != " " or chars[i + 1] != " ":
            out[((pair * 0xD6E8FEB86659FD93) & mask) >> 50] += 1
        if i + 2 < len(chars) and chars[i + 1] != " ":
            triple = (pair * 0xC2B2AE3D27D4EB4F + ord(chars[i + 2]) + 1) & mask
            out[((triple * 0xD6E8FEB86659FD93) & mask) >> 50] += 1
    return out if any(c != " " for c in chars) else Counter()


def test_languages_against_plain_prediction(spark):
    rows, _ = corpus(260, seed=4)
    rows += [(7000, "kato wexgul 12 éaçon", None, "s", 1, "x", 9, 9), (7001, None, "aa", "s", 1, "x", 9, 9), (7002, "12 ?", "aa", "s", 1, "x", 9, 9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    limit = 40
    model = langid.fit(docs, rows_per_language=limit)
    marks = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang", F.lit(3)).alias("mark"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    chosen = []
    for lang in ("aa", "bb", "cc"):
        pool = sorted((r["mark"], r["tie"], r["text"], lang) for r in marks if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)
        assert len(pool) > limit
        chosen += pool[:limit]
    sample = []
    for mark, _, text, lang in sorted(chosen, key=lambda r: r[:2]):
        counts = plain_buckets(text)
        if counts:
            order = sorted(counts)
            sample.append((np.array(order), np.array([float(counts[b]) for b in order]), ("aa", "bb", "cc").index(lang), mark % langid.VALIDATION_PART == 0))
    again = langid.train(sample, ("aa", "bb", "cc"))
    assert model.names == again.names and np.allclose(model.weights, again.weights) and np.allclose(model.bias, again.bias) and model.temperature == again.temperature

    def chances(text, t):
        counts = plain_buckets(text)
        z = [sum(n * model.weights[b][k] for b, n in counts.items()) / sum(counts.values()) + model.bias[k] for k in range(3)]
        e = [math.exp((v - max(z)) / t) for v in z]
        return [v / sum(e) for v in e]

    for r in langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not plain_buckets(r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        p = chances(r["text"], model.temperature)
        assert r["lang_pred"] == model.names[p.index(max(p))] and r["score"] == pytest.approx(max(p)) and r["rejected"] == (r["score"] < model.reject_below)

    check = [(t, lang) for mark, _, t, lang in chosen if mark % langid.VALIDATION_PART == 0 and plain_buckets(t)]

    def loss(t):
        return -sum(math.log(max(chances(text, t)[model.names.index(lang)], 1e-12)) for text, lang in check)

    grid = [math.exp(math.log(0.02) + i * (math.log(20) - math.log(0.02)) / 119) for i in range(120)]
    assert loss(model.temperature) <= min(loss(t) for t in grid) + 1e-9
