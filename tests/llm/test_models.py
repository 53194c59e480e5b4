"""Toxicity, language identification and nearest neighbours against held-out rows and brute force."""

import random
import zlib

import numpy as np
import pytest

from cohortcast.llm import ann, langid, toxicity

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, label INT, at INT"
PARTS = {"aa": ["ka", "to", "ri", "mo", "ne", "su"], "bb": ["wex", "gul", "zor", "plim", "drak"], "cc": ["éa", "çon", "ñi", "öl", "ßte"]}
BAD = ["vikkop", "smurgle", "jaffid"]


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "ka", "zor"])
        rows.append((i, " ".join(words) + ".", lang, "s", 1, "x", 9, 9))
        labels.append((i, 1, int(toxic)))
    return rows, labels


ODD = [(9001, None), (9002, ""), (9003, "... 123 !!"), (None, "kato rimo nesu"), (9004, "wexgul " * 60_000), (9005, "x" * 300_000)]


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus()
    rows = rows + [(i, t, None, None, None, None, None, None) for i, t in ODD] + rows[:3]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(
        labels + labels[:5] + [(None, 1, 1), (7, None, None), (123456, 0, 1)], "doc_id BIGINT, quality INT, toxic INT"), rows, dict((a, c) for a, _, c in labels)


def test_toxicity_on_held_out_rows(made):
    docs, labels, rows, truth = made
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    blank = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (9001, 9002, 9003)}
    assert blank == {9001: 0, 9002: 0, 9003: 0}


def test_toxicity_never_reads_held_out_labels(spark, made):
    docs, labels, _, _ = made
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) toxic")
    one, two = toxicity.toxicity(docs, labels), toxicity.toxicity(docs, flipped)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_toxicity_without_labels(made):
    docs, labels, rows, _ = made
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, None).count() == len(rows)
    left = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert left.columns == docs.columns and 0.6 * len(rows) < left.count() < 0.9 * len(rows)


def test_toxicity_uses_every_counted_gram(made, monkeypatch):
    """However few n-grams the tasks hold, all of the tables score."""
    docs, labels, _, _ = made
    whole = toxicity.fit(docs, labels)
    scores = sorted(map(str, toxicity.score_documents(docs, whole).collect()))
    left = sorted(map(str, toxicity.drop_toxic(docs, whole).collect()))
    monkeypatch.setattr(toxicity, "HOT", 100)
    few = toxicity.fit(docs, labels)
    assert whole.hot.whole and not few.hot.whole and len(few.hot.grams) == 100 < few.grams.count() and few.curve == whole.curve
    assert sorted(map(str, toxicity.score_documents(docs, few).collect())) == scores
    assert sorted(map(str, toxicity.drop_toxic(docs, few).collect())) == left
    assert few.score(["kato vikkopzor rimo"])[0] == pytest.approx(whole.score(["kato vikkopzor rimo"])[0])


def test_counts_match_plain_counting():
    texts = ["Abc abc, d", "", "abd"]
    g = list(toxicity.letter_events(texts))[0]
    ends = [sum(g.ends[g.doc == i]) for i in range(3)]
    assert ends == [3, 0, 1] and len(g.gram) == sum(len(w) + 1 for w in ("abc", "abc", "d", "abd"))
    first, again, third = g.gram[:4], g.gram[4:8], g.gram[10:]
    assert (first == again).all() and (first[:2] == third[:2]).all() and first[2] != third[2] and g.context[2] == g.context[12]


def test_events_are_cut_without_loss(monkeypatch):
    texts = ["one two three " * 40, "xyz " * 30]
    whole = list(toxicity.letter_events(texts))[0]
    monkeypatch.setattr(toxicity, "SEGMENT", 50)
    parts = list(toxicity.letter_events(texts))
    assert len(parts) > 5 and (np.concatenate([p.gram for p in parts]) == whole.gram).all() and (np.concatenate([p.doc for p in parts]) == whole.doc).all()


def test_languages(made):
    docs, _, rows, _ = made
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (9001, 9002, 9003))
    assert next(r for r in got if r["doc_id"] == 9004)["lang_pred"] == "bb"


def test_letters_beyond_the_basic_plane(spark, made):
    """Emoji and astral digits are no letters, astral letters are."""
    odd = {1: "😀🎉 😀", 2: "𝟘𝟙𝟚 123", 3: "𐐀𐐁 𐐂", 4: "😀 kato", 5: "\U0002070e", 6: "½ ² ①"}
    docs = made[0].unionByName(spark.createDataFrame([(20_000 + i, t, None, None, None, None, None, None) for i, t in odd.items()], SCHEMA))
    got = {r["doc_id"] - 20_000: r["lang_pred"] for r in langid.identify(docs).collect() if (r["doc_id"] or 0) > 20_000}
    assert {i for i, lang in got.items() if lang == "und"} == {i for i, t in odd.items() if not any(c.isalpha() for c in t)} == {1, 2, 6}
    assert [len(list(toxicity.letter_events([t]))) and sum(g.ends.sum() for g in toxicity.letter_events([t])) for t in odd.values()] == [0, 0, 2, 1, 1, 0]


def test_no_language_to_learn(made):
    docs = made[0]
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, query STRING, score STRING")


def brute_force(rows, every=50, k=5):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = min(seen.get(i, v), v)
    out = {}
    for q in (i for i in seen if i % every == 0):
        a = np.array(seen[q], np.float32).astype(float)
        near = []
        for i, v in seen.items():
            if i != q and len(v) == len(a):
                b = np.array(v, np.float32).astype(float)
                near.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
        out[q] = sorted(near)[:k]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 24))
    rows = [(i, [float(x) for x in (centers[i % 8] + 0.7 * rng.normal(size=24)).astype(np.float32)], 1, "q", "s") for i in range(2500)]
    hot = rows[50][1]
    rows = [(r[0], hot if r[0] % 3 == 0 else r[1], *r[2:]) for r in rows]
    rows += [(3000, None, 1, "", ""), (3050, [0.0] * 24, 1, "", ""), (3100, [1.0] * 23 + [float("nan")], 1, "", ""), (3150, [1.0] * 23 + [None], 1, "", ""),
             (None, hot, 1, "", ""), (3200, [1.0, 2.0], 1, "", ""), (3201, [2.0, 1.0], 1, "", ""), (3250, [1.0, 2.0, 3.0], 1, "", ""), (3300, [], 1, "", ""),
             rows[7], (rows[8][0], [9.0] * 24, 1, "", "")]
    got = {}
    for r in ann.nearest(vectors(spark, rows).repartition(5)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_force(rows)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        total += len(near)
        hits += len({m[1] for m in mine} & {i for _, i in near})
    assert not set(got) - {q for q, near in want.items() if near} and hits >= 0.95 * total
    tied = sorted(got[150])
    assert [m[1] for m in tied] == [0, 3, 6, 9, 12] and {m[2] for m in tied} == {tied[0][2]}


def test_nearest_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "", ""), (1, [0.0, 1.0], 1, "", ""), (2, [1.0, 1.0], 1, "", "")]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors(spark, rows)).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(vectors(spark, rows).limit(0)).count() == 0
    assert ann.nearest(vectors(spark, rows[1:])).count() == 0


def test_chi_square():
    for p in (0.5, 0.9, 0.96):
        assert ann.chi_square_cdf(ann.chi_square_quantile(p, 16), 16) == pytest.approx(p)
    assert ann.chi_square_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)
