"""Tool-call linking: join calls with their results, order them, check arguments, write canonical JSON.

Calls and results are tables of their own. They meet in one hash join on (conversation, identifier). A call may name
others that it comes after; the order is a fixed point of (turn, hop): a call takes the largest
of its own turn and what it comes after, one hop later. Where the log is already in order a single
join confirms it; each further round follows one more link that points forward in the log. A conversation that still moves after
`ROUNDS` rounds has a long chain or a cycle; only then the identifiers and links of that one conversation are sorted in one task.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import map_texts, null_safe, word_count
from cohortcast.session import materialize

ROUNDS = 32
REPLY_SCHEMA = {
    "type": "object", "required": ["message", "words"], "additionalProperties": False,
    "properties": {"message": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}},
}
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and no needless escapes; NaN and infinity are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_errors(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """Breaches of a small part of JSON Schema: type, enum, bounds, lengths, required, properties, items."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"integer": number and float(value).is_integer() if number else False, "number": number}.get(
        kind, isinstance(value, TYPES.get(kind, object)))
    if kind and not fits:
        return [f"{at}: not {kind}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if number:
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in schema_errors(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{name}: unknown" for name in sorted(value) if name not in known]
        out += [e for name in sorted(known) if name in value for e in schema_errors(value[name], known[name], f"{at}.{name}")]
    return out


def _settled(calls: pd.DataFrame) -> pd.DataFrame:
    """Place of every call of one conversation by removing ready calls; null for all if some are on a cycle or after one."""
    place = {c: (int(t), 0) for c, t in zip(calls["call_id"], calls["turn"])}
    waits, followers = dict.fromkeys(place, 0), {}
    for call, after in zip(calls["call_id"], calls["after"]):
        for needed in {n for n in (() if after is None else after) if n in place}:
            waits[call] += 1
            followers.setdefault(needed, []).append(call)
    ready = [c for c, n in waits.items() if not n]
    for call in ready:
        turn, hop = place[call]
        for follower in followers.get(call, ()):
            place[follower] = max(place[follower], (turn, hop + 1))
            waits[follower] -= 1
            if not waits[follower]:
                ready.append(follower)
    whole = len(ready) == len(place)
    return pd.DataFrame({"key": calls["key"], "call_id": calls["call_id"],
                         "late_turn": pd.array([place[c][0] if whole else None for c in calls["call_id"]], "Int64"),
                         "late_hop": pd.array([place[c][1] if whole else None for c in calls["call_id"]], "Int64")})


def _ordered(calls: DataFrame) -> DataFrame:
    """Add order_turn and order_hop; both null in a conversation with a cycle."""
    links = materialize(calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("needs")).where("needs is not null"), "call-links")
    place = materialize(calls.select("conv", "call_id", F.struct(F.col("turn").alias("turn"), F.lit(0).alias("hop")).alias("place")), "call-order")
    moving = None
    for _ in range(ROUNDS):
        before = links.join(place.withColumnRenamed("call_id", "needs"), ["conv", "needs"]).groupBy("conv", "call_id").agg(
            F.max(F.struct(F.col("place.turn").alias("turn"), (F.col("place.hop") + 1).alias("hop"))).alias("needed"))
        step = materialize(place.join(before, ["conv", "call_id"], "left").select(
            "conv", "call_id", F.greatest("place", F.coalesce("needed", "place")).alias("next"), "place"), "call-order")
        moving = step.where(F.col("next") != F.col("place"))
        place = step.select("conv", "call_id", F.col("next").alias("place"))
        if moving.isEmpty():
            return calls.join(place, ["conv", "call_id"]).select(calls["*"], F.col("place.turn").alias("order_turn"), F.col("place.hop").alias("order_hop"))
    stuck = moving.select("conv", F.lit(True).alias("stuck")).distinct()
    key = F.concat(F.when(F.col("conv.none"), "n").otherwise("s"), F.coalesce(F.col("conv.some").cast("string"), F.lit("")))
    late = (calls.join(stuck, "conv", "left_semi").select(key.alias("key"), F.col("call_id").cast("string").alias("call_id"), "turn", F.col("after").cast("array<string>").alias("after"))
            .groupBy("key").applyInPandas(_settled, "key string, call_id string, late_turn bigint, late_hop int"))
    rows = calls.join(place, ["conv", "call_id"]).join(stuck, "conv", "left").withColumn("key", F.when(F.col("stuck"), key))
    rows = rows.join(late.withColumnRenamed("call_id", "late_id"), (rows["key"] == late["key"]) & (rows["call_id"].cast("string") == F.col("late_id")), "left")
    return rows.select(calls["*"], *(F.when(F.col("stuck").isNull(), F.col(f"place.{c}")).otherwise(F.col(f"late_{c}")).alias(f"order_{c}") for c in ("turn", "hop")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Calls with their results, in order, checked and serialised.

    `calls` has conv_id, call_id, turn, name, arguments (JSON text) and after (identifiers it must follow; unknown ones do not
    count); `results` has conv_id, call_id, turn and content. Output, one row per identifier of a conversation: conv_id, call_id,
    order_turn, order_hop, status (linked, unanswered or orphan), errors (array) and json. Sorting a conversation by order_turn,
    order_hop, call_id gives a topological order, both are null where links form a cycle. An identifier used twice means its first turn, for calls and for
    results (ties by content). Rows with a null call_id link to nothing and are left out; a null conv_id is a conversation of its
    own; arguments that are null, no JSON or against the schema, and unknown tools, give errors. Other columns are ignored.
    """
    call = (calls.where("call_id is not null").select(null_safe(F.col("conv_id")).alias("conv"), "call_id", F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("name").alias("name"), F.col("arguments").alias("arguments"), F.col("after").alias("after")).alias("c"))
        .groupBy("conv", "call_id").agg(F.min("c").alias("c")).select("conv", "call_id", "c.*"))
    call = materialize(call.withColumn("turn", F.coalesce("turn", F.lit(0).cast("bigint"))), "calls")
    answer = (results.where("call_id is not null").select(null_safe(F.col("conv_id")).alias("conv"), "call_id", F.struct(
        F.col("turn").cast("bigint").alias("result_turn"), F.col("content").alias("content")).alias("r"))
        .groupBy("conv", "call_id").agg(F.min("r").alias("r")).select("conv", "call_id", "r.*", F.lit(True).alias("answered")))
    both = _ordered(call).withColumn("called", F.lit(True)).join(answer, ["conv", "call_id"], "full")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    rows = both.select(F.col("conv.some").cast("string").alias("conv_id"), "call_id", F.coalesce("order_turn", F.when(F.col("called").isNull(), F.col("result_turn"))).alias("order_turn"),
                       "order_hop", status.alias("status"), "name", "arguments", "content")
    schemas = dict(schemas)

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        errors, lines = [], []
        for row in batch.to_pylist():
            found, value = [], None
            if row["status"] != "orphan":
                try:
                    value = json.loads(row["arguments"] or "")
                    canonical(value)
                except ValueError:
                    found, value = ["$: no JSON"], None
                if row["name"] not in schemas:
                    found.append("$: unknown tool")
                elif not found:
                    found = schema_errors(value, schemas[row["name"]])
            errors.append(found)
            lines.append(canonical({"id": row["call_id"], "name": row["name"], "arguments": value, "result": row["content"], "status": row["status"]}))
        columns = [batch.column(i) for i in range(5)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
                                          names=["conv_id", "call_id", "order_turn", "order_hop", "status", "errors", "json"])

    schema = "conv_id string, call_id string, order_turn bigint, order_hop int, status string, errors array<string>, json string"
    return map_texts(rows, rows.columns, schema, write)


TURN = ["conv_id", "turn", "role"]


def first_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation, turn and role: the smallest text, null only where all are, with the number of its rows."""
    counted = conversations.groupBy(*TURN, "text").agg(F.count("*").alias("copies"))
    return counted.groupBy(*TURN).agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "copies")).alias("one")).select(*TURN, "one.text", "one.copies")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of plain conversations as calls and results.

    A user turn asks for a reply: a call named "reply" whose identifier is conversation:turn, after the one two turns before. An
    assistant turn is the result of the turn before it. Of repeated turns the first counts (see `other_turns` for the rest). Null turns get no identifier.
    """
    def name(back: int):
        return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(":"), (F.col("turn") - back).cast("string"))

    message, firsts = F.coalesce("text", F.lit("")), first_turns(conversations)
    calls = firsts.where("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(message.alias("message"), word_count(message).alias("words"))).alias("arguments"), F.array(name(2)).alias("after"))
    results = firsts.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that are neither a call nor a result, in the columns of `link_calls`.

    Status `context`: turns of other roles or none; `unplaced`: user and assistant turns without a number; `repeated`: further
    rows of a numbered user or assistant turn. `json` holds role, content, status and, for equal rows, how many they are.
    """
    counted = conversations.groupBy(*TURN, "text").agg(F.count("*").alias("copies"))
    speaks = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    firsts = first_turns(conversations.where(speaks & F.col("turn").isNotNull())).select(
        *[F.col(c).alias(f"first_{c}") for c in TURN], F.col("text").alias("first_text"), F.lit(True).alias("first"))
    same = F.lit(True)
    for c in [*TURN, "text"]:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    left = F.col("copies") - F.coalesce(F.col("first"), F.lit(False)).cast("bigint")
    status = F.when(~speaks, "context").when(F.col("turn").isNull(), "unplaced").otherwise("repeated")
    rows = (counted.join(firsts, same, "left").withColumn("left", left).where("left > 0")
            .select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text", "left", status.alias("status")))

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [canonical({"role": r["role"], "content": r["text"], "copies": r["left"], "status": r["status"]}) for r in batch.to_pylist()]
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.nulls(n, pa.string()), batch.column(1), pa.nulls(n, pa.int32()), batch.column(5), pa.array([[]] * n, pa.list_(pa.string())), pa.array(lines, pa.string())],
            names=["conv_id", "call_id", "order_turn", "order_hop", "status", "errors", "json"])

    return map_texts(rows, rows.columns, "conv_id string, call_id string, order_turn bigint, order_hop int, status string, errors array<string>, json string", write)
