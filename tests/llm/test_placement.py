"""Hash tree shards, product codes and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.llm import codes, negatives, sharding

DOCS = "doc_id BIGINT, text STRING, shard STRING, slot INT, document STRING, __mark STRING"


def walk(key, tree):
    """Descend with md5 and math.log."""
    children, path = tree.children(), ""
    for _ in range(3):
        draws = []
        for name, weight in children[path]:
            to = f"{path}/{name}"
            u = (int(hashlib.md5(f"{key}:{to}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
            draws.append((-math.log(u) / weight, to))
        path = min(draws)[1]
    return int(path.split("/")[-1])


def places(spark, n, tree):
    keys = spark.range(n).select(F.col("id").cast("string").alias("k"))
    return {int(r["k"]): r["s"] for r in keys.select("k", sharding.shard_of(F.col("k"), tree).alias("s")).collect()}


def test_sharding_rows_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i if i % 11 else None, rng.choice([None, "", "é😀 text", "a" * 200_000, f"t{i}", "same"]), "x", i, "y", None) for i in range(300)]
    rows += [rows[7]] * 50 + [(7, "other", "x", 0, "y", None)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    for slot_rows in (sharding.SLOT_ROWS, 8):  # many ranges, and copies of a row above a range's size
        got = sharding.assign(frame, slot_rows=slot_rows).collect()
        now, grown = sharding.layout(), sharding.layout(added=1)
        want = []
        for i, t, *_ in rows:
            b, key = (t or "").encode(), "null" if i is None else str(i)
            want.append((i, len(b) + 16, zlib.crc32(b), "key", walk(key, now), walk(key, grown)))
        cols = ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
        assert sorted([tuple(r[c] for c in cols) for r in got], key=str) == sorted(want, key=str)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append((r["slot"], hashlib.md5(f"{'null' if r['doc_id'] is None else r['doc_id']}:{r['size']}:{r['text_crc32']}".encode()).hexdigest()))
        for held in slots.values():
            held.sort()
            assert [s for s, _ in held] == list(range(len(held))) and [m for _, m in held] == sorted(m for _, m in held)
        assert sorted([tuple(r["document"]) for r in got], key=str) == sorted(rows, key=str)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    a, b = places(spark, 20_000, sharding.layout()), places(spark, 20_000, sharding.layout(added=1))
    assert set(a.values()) == set(range(40)) and {b[k] for k in a if a[k] != b[k]} == {40}
    moved = sum(a[k] != b[k] for k in a)
    assert abs(moved - 20_000 / 41) < 6 * math.sqrt(20_000 / 41)
    c = places(spark, 20_000, sharding.layout(added=2))
    assert {c[k] for k in b if b[k] != c[k]} == {41}


def test_weights_decide_shares_and_confine_movement(spark):
    tree = sharding.Tree({"a": {"k0": {0: 1.0, 1: 2.0}, "k1": {2: 3.0}}, "b": {"k0": {3: 2.0, 4: 0.0}, "k1": {5: 4.0}}})
    n = 24_000
    old = places(spark, n, tree)
    count = Counter(old.values())
    assert 4 not in count
    for shard, weight in {0: 1, 1: 2, 2: 3, 3: 2, 5: 4}.items():
        assert abs(count[shard] - n * weight / 12) < 6 * math.sqrt(n * weight / 12)
    # rack a/k0 and region a get heavier: rows enter them, and within the rack the heavier shard; no row leaves them, none moves within region b
    heavier = sharding.Tree({"a": {"k0": {0: 1.0, 1: 4.0}, "k1": {2: 3.0}}, "b": {"k0": {3: 2.0, 4: 0.0}, "k1": {5: 4.0}}})
    new = places(spark, n, heavier)
    moves = {(old[k], new[k]) for k in old if old[k] != new[k]}
    allowed = {0: {1}, 1: set(), 2: {0, 1}, 3: {0, 1, 2}, 5: {0, 1, 2}}
    assert moves and all(to in allowed[src] for src, to in moves)
    lighter = places(spark, n, tree)
    assert {(new[k], lighter[k]) for k in old if new[k] != lighter[k]} == {(b, a) for a, b in moves}
    with pytest.raises(ValueError):
        sharding.layout(0).children()
    with pytest.raises(ValueError):
        sharding.Tree({"a": {"k": {0: -1.0}}}).children()


def test_sharding_empty_and_written(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.assign(empty).collect() == []
    frame = spark.createDataFrame([(i, f"text {i}", "x", i, "y", None) for i in range(200)], DOCS)
    sharding.write_shards(sharding.assign(frame, sharding.layout(4), sharding.layout(4, 1)), str(tmp_path / "out"), files_rows=16)
    back = spark.read.parquet(str(tmp_path / "out")).select("shard", "slot", "document.doc_id", "document.text").collect()
    assert len(back) == 200 and all(r["text"] == f"text {r['doc_id']}" and r["shard"] == walk(str(r["doc_id"]), sharding.layout(4)) for r in back)


# ── product codes ───────────────────────────────────────────────────────────


def brute_codes(rows, parts, entries, rounds):
    """Every round against every entry in whole numbers of Python."""
    x = [[max(-codes.LARGEST, min(codes.LARGEST, math.floor(256 * v))) for v in r[1]] for r in rows]
    width = len(x[0])
    at = codes.cuts(width, parts)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[x[i][c] for i in order] for c in at]

    def assign():
        return [[min(((sum((a - b) ** 2 for a, b in zip(v[c], e)), j) for j, e in enumerate(book))) for c, book in zip(at, books)] for v in x]
    for _ in range(rounds):
        coded = assign()
        for p, c in enumerate(at):
            for j in range(len(books[p])):
                mine = [v[c] for v, code in zip(x, coded) if code[p][1] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    coded = assign()
    text = ",".join(str(v) for book in books for e in book for v in e)
    return ["".join("%02x" % j for _, j in c) for c in coded], [sum(d for d, _ in c) for c in coded], hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, code STRING, error INT"


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    out = [(i, [float(np.float32(v)) for v in centres[i % 6] + spread * rng.standard_normal(width)], i % 6, "x", 1) for i in range(n)]
    return [(i, e, None if i % 10 == 3 else lab, c, d) for i, e, lab, c, d in out]


@pytest.mark.parametrize("width,parts,entries,rounds", [(16, 4, 8, 2), (10, 4, 5, 4), (6, 3, 64, 2), (2, 4, 3, 3)])
def test_codes_against_brute_force(spark, width, parts, entries, rounds):
    rows = vectors(150, width, width)
    rows += [rows[4]] * 20 + [(None, rows[5][1], 2, "x", 1), (9, rows[11][1], 1, "x", 1)]
    bad = [(500, None, 1, "x", 1), (501, [1.0] * (width - 1) + [float("nan")], 1, "x", 1), (502, [None] + [0.0] * (width - 1), 1, "x", 1), (503, [float("inf")] * width, 1, "x", 1)]
    got = codes.compress(spark.createDataFrame(bad + rows, VECTORS).repartition(4), parts, entries, rounds).collect()
    code, error, book = brute_codes(rows, parts, entries, rounds)
    per_label = Counter()
    for r, e in zip(rows, error):
        per_label[r[2]] += e
    want = [(r[0], c, e, per_label[r[2]], book) for r, c, e in zip(rows, code, error)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert sum(r["rescans"] for r in got) < len(rows) * parts * rounds


def test_bounds_skip_and_use_net_displacement():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((4000, 4)) * 200)
    history, state, skipped = [x[:16].copy()], None, 0
    for _ in range(8):
        code, own, bound, stamp, again = codes.assign_part(x, history, state)
        full = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (own == full.min(1)).all()
        skipped += (~again).sum()
        state = code, bound, stamp
        history.append(np.array([np.floor(x[code == j].mean(0)) if (code == j).any() else history[-1][j] for j in range(16)]))
    assert skipped > 4000
    there_and_back = [history[0], history[0] + 50, history[0]]
    assert codes._drift(there_and_back[2], there_and_back[0]).max() == 0 < codes._drift(there_and_back[1], there_and_back[0]).max()


def test_codes_odd_tables(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [1e30, -1e30], 1, "x", 1), (2, [0.0, 0.0], 1, "x", 1), (3, [], None, "x", 1), (4, [0.5], 1, "x", 1)]
    got = {r["vec_id"]: r for r in codes.compress(spark.createDataFrame(rows, VECTORS), 2, 4, 1).collect()}
    assert len(got) == 4 and got[3]["error"] == 0 and got[3]["code"] == "0000" and all(r["error"] == 0 for r in got.values())


# ── hard negatives ──────────────────────────────────────────────────────────


def brute_negatives(rows, every, positives, k):
    rows = [(i, [max(-codes.LARGEST, min(codes.LARGEST, math.floor(256 * v))) for v in e], lab) for i, e, lab in rows]
    out = []
    for i, e, lab in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, other) for j, f, other in rows if j != i and len(e) == len(f))
        for ps, j, _ in [s for s in scored if s[2] == lab][:positives]:
            found = [(ns, n) for ns, n, other in scored if other != lab and 30 * -ps <= 100 * -ns <= 90 * -ps][:k]
            out += [(i, j, at + 1, n, -ps, -ns) for at, (ns, n) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16_384, 32_768), (40, 3)])
def test_negatives_against_brute_force(spark, blocks):
    rows = [(i, e, lab) for i, e, lab, *_ in vectors(260, 5, 3, 0.8) if lab is not None]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]          # copies under several labels: ties
    rows += [(2000 + i, [float(v) for v in e], 9) for i, e in enumerate([[0] * 5, [-1, 0, 0, 0, 0], [1, 2, 3]])]  # zero scores, another width
    frame = spark.createDataFrame([(i, e, lab, "x", 1) for i, e, lab in rows] + [
        (None, [1.0] * 5, 1, "x", 1), (3000, None, 1, "x", 1), (3001, [float("nan")] * 5, 1, "x", 1), (3002, [1.0] * 5, None, "x", 1), (rows[2][0], rows[2][1], rows[2][2], "x", 1)], VECTORS)
    got = negatives.mine(frame.repartition(3), 10, row_block=blocks[0], anchor_block=blocks[1]).collect()
    want = brute_negatives(rows, 10, 5, 10)
    assert sorted(map(tuple, got)) == want and len(want) > 500


def test_negatives_odd_tables(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1, "x", 1), (1, [2.0], 1, "x", 1)], VECTORS)).collect() == []
    below = [(0, [1.0], 1, "x", 1), (1, [-2.0], 1, "x", 1), (2, [-1.0], 2, "x", 1)]
    assert negatives.mine(spark.createDataFrame(below, VECTORS)).collect() == []


def test_best_keeps_order_and_ties():
    rng = np.random.default_rng(2)
    best, seen = negatives.Best(4, 3), defaultdict(list)
    for start in range(0, 400, 40):
        at, ids, scores = rng.integers(0, 4, 40), np.arange(start, start + 40), rng.integers(0, 9, 40).astype(float)
        best.add(at, ids, scores)
        for a, i, s in zip(at, ids, scores):
            seen[a].append((-s, i))
    for place, held in seen.items():
        assert [(-s, i) for s, i in zip(best.scores[place], best.ids[place])] == sorted(held)[:3]
