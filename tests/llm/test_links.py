"""Sentence spans and tool-call linking against plain Python."""

import json
import random
import re

import xxhash

from cohortcast.llm import chat, spans

SCHEMA = "doc_id BIGINT, text STRING, id STRING, span INT, hits STRING"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def word_hash(word):
    """The bytes' numbers times powers, mixed, one byte after another in whole numbers of Python."""
    total = 0
    for i, byte in enumerate(word.lower().encode()):
        total += int(spans.BYTE_VALUES[byte]) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)
    x = total % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return x ^ (x >> 31)


def sentences(text):
    """Word lists: split at blanks after a mark and at line ends, long ones cut at words with the least hash of nine."""
    out = []
    for part in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n+", text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", part)
        borders = {0}
        if len(ws) > 25:
            h = [word_hash(w) for w in ws]
            borders |= {max(range(i, i + 9), key=lambda j: (-h[j], j)) for i in range(1, len(ws) - 8)}
        at = [*sorted(borders), len(ws)]
        out += [ws[i:j] for i, j in zip(at, at[1:]) if ws]
    return out


def sentence_runs(found):
    """First and last sentence of every run."""
    for i in range(len(found)):
        size = next((k for k in range(3, len(found) - i + 1) if sum(map(len, found[i:i + k])) >= 12), None)
        if size:
            yield 2 * i, i, i + size - 1
        if i + 1 < len(found) and len(found[i]) + len(found[i + 1]) > 25:
            yield 2 * i + 1, i, i + 1


def brute_repeats(rows):
    """{(doc_id, text): removed sentence numbers} by comparing every run with every other."""
    seen = {}
    for i, t in {(i, t or "") for i, t in rows}:
        found = sentences(t)
        mark = xxhash.xxh64_intdigest(t.encode(), seed=42)
        mark = mark - (1 << 64) if mark >> 63 else mark
        for number, first, last in sentence_runs(found):
            key = " ".join(w.lower() for ws in found[first:last + 1] for w in ws)
            seen.setdefault(key, []).append(((i is None, i or 0, mark, number), (i, t), first, last))
    gone = {}
    for places in seen.values():
        for _, doc, first, last in sorted(places)[1:]:
            gone.setdefault(doc, set()).update(range(first, last + 1))
    return gone


def test_spans_against_brute_force(spark):
    rng = random.Random(2)
    sentence = lambda n: " ".join("w%d" % rng.randint(0, 3000) for _ in range(n)).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence(rng.randint(3, 18)) for _ in range(5)) for _ in range(4)] + [" ".join(f"u{i}" for i in range(70))]
    rows = []
    for i in range(60):
        parts = [sentence(rng.randint(1, 20)) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "tiny. tiny. tiny. tiny."), rows[5], rows[6], (7, rows[5][1]), (104, ("same words again here now. " * 4000))]
    got = spans.drop_repeats(frame(spark, rows).repartition(4)).collect()
    gone = brute_repeats(rows)
    want = []
    for i, t in rows:
        hit, found = gone.get((i, t or ""), ()), sentences(t or "")
        want.append((i, None if t is None else " ".join(w for k, ws in enumerate(found) if k not in hit for w in ws), len(found), len(hit)))
    mine = [(r["doc_id"], None if r["text"] is None else " ".join(r["text"].split()), r["n_sentences"], r["n_removed"]) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str) and sum(r[3] > 0 for r in mine) > 15
    clean = [r for r in got if r["n_removed"] == 0 and r["text"]]
    assert {(r["doc_id"], r["text"]) for r in clean} <= set(rows)


def test_long_passages_always_hold_a_run():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join("w" + (rng.choice(["", "", "", "."]) if rng.random() < 0.5 else "") for _ in range(51))
        assert len(spans.span_hashes([text])[2]) >= 1
    assert len(spans.span_hashes(["One line of a footer. It has two sentences and no more than that, in all twenty words or so here."])[2]) == 0


def test_passages_planted_inside_sentences(spark):
    """Passages at different offsets: 51 words within a long sentence, and 76 words over short ones cut at both ends."""
    rng = random.Random(6)
    other = lambda n: [f"w{rng.randint(0, 10 ** 9)}" for _ in range(n)]
    rows, pairs = [], []
    for length, most in ((51, None), (60, None), (76, 25), (76, 13), (90, 25)):
        for before in range(0, 24, 3):
            words = other(length)
            ends = range(0) if most is None else range(rng.randint(0, most - 1), length - 1, most)
            body = " ".join(w + "." * (i in ends) for i, w in enumerate(words))
            pair = [" ".join([*other(3), "start. " + " ".join([*other(n), body, *other(m)]) + "."]) for n, m in ((before % 7, 4), (before, 9))]
            pairs.append((len(rows) + 1, length))
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = {r["doc_id"]: r["text"] for r in spans.drop_repeats(frame(spark, rows)).collect()}
    for number, length in pairs:
        assert got[number - 1] == rows[number - 1][1]
        lost = len(rows[number][1].split()) - len(got[number].split())
        assert 12 <= lost <= length, (number, length)


def test_segmentation_against_plain_python():
    rng = random.Random(9)
    alphabet = ["a", "B", "é", "İ", "Σ", ".", "!", "?", " ", "  ", "\n", "\t", "\x0b", "\u2003", "\xa0", "😀", "word ", "x" * 40 + " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 30, 400]))) for _ in range(300)] + ["y" * 200_000, "z " * 3000]
    counts, text, number, hashes = spans.span_hashes(texts)
    assert counts.tolist() == [len(sentences(t)) for t in texts]
    want = {(i, n): " ".join(w.lower() for ws in sentences(t)[a:b + 1] for w in ws) for i, t in enumerate(texts) for n, a, b in sentence_runs(sentences(t))}
    got = dict(zip(zip(text.tolist(), number.tolist()), hashes.tolist()))
    assert got.keys() == want.keys() and len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in got})


def test_common_passage_in_most_documents(spark):
    """One run in more than a thousandth of the rows takes the broadcast way and gives the same result."""
    passage = "First of the shared lines here. Second shared line of the passage. Third shared line closes it now."
    rows = [(i, f"Own words number {i} stand here. " + (passage if i % 3 else "Nothing else.")) for i in range(400)]
    got = {r["doc_id"]: r["n_removed"] for r in spans.drop_repeats(frame(spark, rows)).collect()}
    assert got == {i: 3 if i % 3 and i > 1 else 0 for i, _ in rows}


def test_spans_empty(spark):
    assert spans.drop_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0


CALLS = "conv_id STRING, call_id STRING, turn BIGINT, name STRING, arguments STRING, after ARRAY<STRING>, place STRING, hits INT"
RESULTS = "conv_id STRING, call_id STRING, turn BIGINT, content STRING, place STRING"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}}, "mode": {"enum": ["x", "y"]}}}}


def test_link_calls(spark):
    calls = [
        ("c", "k1", 5, "add", '{"tags": ["b", "a"], "a": 2}', ["k3"]), ("c", "k2", 1, "add", '{"a": -1, "z": 0, "mode": "q", "tags": ["long!"]}', []),
        ("c", "k3", 9, "add", '{"a": 1.5}', ["k4", "gone", None]), ("c", "k4", 9, "add", "{bad", None), ("c", "k5", 2, "none", "{}", ["k2"]),
        ("c", "k2", 3, "add", '{"a": 7}', []), ("c", None, 3, "add", '{"a": 7}', []), (None, "k1", None, "add", None, []),
        ("d", "x", 1, "add", '{"a": 1}', ["y"]), ("d", "y", 2, "add", '{"a": 1}', ["x"]), ("d", "z", 3, "add", '{"a": 1}', [])]
    results = [("c", "k1", 6, "é\n"), ("c", "k1", 8, "later"), ("c", "lost", 4, None), (None, "k1", 1, "r"), ("c", None, 1, "r")]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(
        spark.createDataFrame([(*c, "p", 1) for c in calls], CALLS), spark.createDataFrame([(*r, "p") for r in results], RESULTS), SCHEMAS).collect()}
    assert len(got) == 10
    order = sorted((k for k in got if k[0] == "c" and got[k]["status"] != "orphan"), key=lambda k: (got[k]["order_turn"], got[k]["order_hop"], k[1]))
    assert [k[1] for k in order] == ["k2", "k5", "k4", "k3", "k1"]
    assert {k: r["status"] for k, r in got.items() if r["status"] != "unanswered"} == {("c", "k1"): "linked", ("c", "lost"): "orphan", (None, "k1"): "linked"}
    assert got["c", "k1"]["json"] == '{"arguments":{"a":2,"tags":["b","a"]},"id":"k1","name":"add","result":"é\\n","status":"linked"}'
    assert got["c", "k2"]["errors"] == ["$.z: unknown", "$.a: below minimum", "$.mode: not in enum", "$.tags[0]: too long"]
    assert got["c", "k3"]["errors"] == ["$.a: not integer"] and got["c", "k4"]["errors"] == ["$: no JSON"] and got["c", "k5"]["errors"] == ["$: unknown tool"]
    assert {got["d", k]["order_turn"] for k in "xyz"} == {None}
    assert got["c", "k1"]["errors"] == []


def test_long_chains_are_ordered(spark):
    """A chain of 100 calls within a turn, one logged in reverse, and a cycle behind a long chain."""
    calls = [("turn", f"k{i:03}", 1, "add", "{}", [f"k{i - 1:03}"] if i else [], "p", 1) for i in range(100)]
    calls += [("back", f"k{i:03}", 100 - i, "add", "{}", [f"k{i - 1:03}", "gone", None] if i else None, "p", 1) for i in range(100)]
    calls += [(None, f"k{i:03}", None, "add", "{}", [f"k{i - 1:03}"] if i else [], "p", 1) for i in range(100)]
    calls += [("cycle", f"k{i:03}", 1, "add", "{}", [f"k{(i or 60) - 1:03}"], "p", 1) for i in range(60)]
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert len(got) == len(calls)
    for conv, turn in (("turn", 1), ("back", 100), (None, 0)):
        mine = {r["call_id"]: (r["order_turn"], r["order_hop"]) for r in got if r["conv_id"] == conv}
        assert mine == {f"k{i:03}": (turn, i) for i in range(100)}
    assert {(r["order_turn"], r["order_hop"]) for r in got if r["conv_id"] == "cycle"} == {(None, None)}


def test_turns_as_calls(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", 'say "é"'), (1, 2, "assistant", "ok"), (1, 3, "user", None), (2, 0, "assistant", "alone"), (None, 1, "user", "x"),
             (3, 1, "user", "word " * 100_000), (1, 1, "user", 'say "é"'), (4, None, "user", "x"), (5, 0, None, "x")]
    calls, results = chat.turns_as_calls(spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))
    got = {r["call_id"]: r for r in chat.link_calls(calls, results, {"reply": chat.REPLY_SCHEMA}).collect()}
    assert sorted(got) == sorted(["1:1", "1:3", "2:-1", "none:1", "3:1"])
    assert json.loads(got["1:1"]["json"]) == {"arguments": {"message": 'say "é"', "words": 2}, "id": "1:1", "name": "reply", "result": "ok", "status": "linked"}
    assert got["1:3"]["errors"] == ["$.message: too short", "$.words: below minimum"] and got["2:-1"]["status"] == "orphan"
    assert got["1:1"]["json"] == chat.canonical(json.loads(got["1:1"]["json"]))
    assert chat.link_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_every_turn_has_a_row(spark):
    turns = [(1, 0, "system", "s"), (1, 0, "system", "s"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "ok"),
             (1, 2, "assistant", "ok"), (None, 1, "user", "x"), (None, 1, "user", "y"), (2, None, "user", "n"), (2, None, "assistant", None), (2, 5, None, "r"), (2, 6, "tool", "t"), (3, 1, "user", None)]
    frame_ = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    calls, results = chat.turns_as_calls(frame_)
    linked = {r["call_id"]: json.loads(r["json"]) for r in chat.link_calls(calls, results, {"reply": chat.REPLY_SCHEMA}).collect()}
    assert {k: (v["arguments"]["message"], v["result"]) for k, v in linked.items()} == {"1:1": ("a", "ok"), "none:1": ("x", None), "3:1": ("", None)}
    rows = [(r["conv_id"], r["order_turn"], json.loads(r["json"])) for r in chat.other_turns(frame_).collect()]
    got = sorted(((c, t, j["role"], j["content"], j["copies"], j["status"]) for c, t, j in rows), key=str)
    assert got == sorted([("1", 0, "system", "s", 2, "context"), ("1", 1, "user", "a", 1, "repeated"), ("1", 1, "user", "b", 1, "repeated"), ("1", 1, "user", None, 1, "repeated"),
                          ("1", 2, "assistant", "ok", 1, "repeated"), (None, 1, "user", "y", 1, "repeated"), ("2", None, "user", "n", 1, "unplaced"),
                          ("2", None, "assistant", None, 1, "unplaced"), ("2", 5, None, "r", 1, "context"), ("2", 6, "tool", "t", 1, "context")], key=str)
    used = sum(1 for v in linked.values()) + sum(v["result"] is not None for v in linked.values())
    assert used + sum(g[4] for g in got) == len(turns)
    assert chat.other_turns(frame_.limit(0)).count() == 0
