"""Secret scan: fixed patterns, and sliding-window entropy per character class over candidate strings.

Everything is DataFrame expressions over one row, so no key can be hot and nothing is shuffled. Positions come
from splitting a text at the matches: a match ends where the lengths of the gaps and matches up to it add up to.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
# a match of AKIA[A-Z0-9]+ with 18 or more characters, one of [0-9a-f]+ with 16 or more
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MARK = "[secret]"


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class and the entropy, in bits, that the best window must reach."""
    kind: str
    pattern: str
    alphabet: str
    fold: bool
    threshold: float


WINDOW = 20
CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", True, 2.95),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", False, 3.63),
)
# allow list (fixed values): placeholders, alphabets, and separated words
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxx|00000000|12345678|abcdefgh"
PLAIN_PART = r"^(?:[A-Za-z]+[0-9]{0,4}|[0-9]{0,4})$"


def _running(lengths: Column) -> Column:
    """Running sums, with a leading 0."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_sums(lengths: Column) -> Column:
    """Running sums of a long array in two levels: blocks of about its root's length, so the work stays near n to the 1.5."""
    n = F.size(lengths)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(lengths, b * width + 1, width))
    sums = F.transform(blocks, _running)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(
        sums, F.slice(_running(F.transform(sums, lambda s: F.element_at(s, -1))), F.lit(1), F.size(sums)),
        lambda block, offset: F.transform(F.slice(block, F.lit(2), F.size(block) - 1), lambda x: x + offset))))


def window_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of `candidate`; null below one window.

    The state holds a count per character of the class and the sum of c log2 c over the counts. A step
    adds the entering character's count, takes off the leaving one's and corrects the sum by these two alone;
    the entropy is log2 w - sum / w, so the smallest sum gives the largest entropy.
    """
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    gain = F.array(*[F.lit(0.0)] + [F.lit(weight[c] - weight[c - 1]) for c in range(1, window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).cast("double").alias("sum"),
                     F.lit(float("inf")).alias("least"), F.array_repeat(F.lit(0), window).alias("recent"))

    def step(state: Column, code: Column) -> Column:
        leaving = F.element_at(state["recent"], 1)
        same = leaving == code
        moved = F.transform(state["counts"], lambda c, k: c + F.when(k + 1 == code, 1).otherwise(0) - F.when(k + 1 == leaving, 1).otherwise(0))
        enter = F.element_at(gain, F.element_at(state["counts"], code) + 2)
        leave = F.when(leaving > 0, F.element_at(gain, F.element_at(state["counts"], leaving) + 1)).otherwise(0.0)
        total = state["sum"] + F.when(same, 0.0).otherwise(enter - leave)
        recent = F.concat(F.slice(state["recent"], 2, window - 1), F.array(code))
        least = F.when(F.element_at(recent, 1) > 0, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(moved.alias("counts"), total.alias("sum"), least.alias("least"), recent.alias("recent"))

    def finish(state: Column) -> Column:
        return F.when(state["least"] < float("inf"), F.lit(math.log2(window)) - state["least"] / window)

    return F.aggregate(codes, start, step, finish)


def allowed(candidate: Column) -> Column:
    """Whether the allow list suppresses a candidate: a placeholder, or plain words and short numbers between separators."""
    return candidate.rlike(PLACEHOLDER) | F.forall(F.split(candidate, "[-_/+]"), lambda part: part.rlike(PLAIN_PART))


def entropy_secret(candidate: Column, kind: CharClass) -> Column:
    folded = F.lower(candidate) if kind.fold else candidate
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    other = F.lit(True) if kind.fold else ~candidate.rlike("^[0-9A-Fa-f]+$")
    return F.when(mixed & other & ~allowed(candidate), window_entropy(folded, kind.alphabet) >= kind.threshold).otherwise(False)


RULES: tuple[tuple[str, str, Callable[[Column], Column] | None], ...] = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS),
    ("access", ACCESS, None),
    ("hex", HEX, None),
    *((c.kind, c.pattern, lambda m, c=c: entropy_secret(m, c)) for c in CLASSES),
)
BASE = 3


def _found(text: Column, pattern: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)


def _spans(number: int, keep: Callable[[Column], Column] | None) -> Column:
    """Spans of the kept matches of a rule, from its matches, gaps and match ends."""
    spans = F.zip_with(f"__found_{number}", f"__ends_{number}", lambda m, end: F.struct(
        (end - F.length(m)).cast("bigint").alias("start"), F.lit(number).alias("kind"), end.cast("bigint").alias("end"), m.alias("text")))
    if keep:
        spans = F.filter(spans, lambda s: keep(s["text"]))
    return F.transform(spans, lambda s: s.dropFields("text"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name, _, _ in RULES])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every text.

    Input needs `doc_id` and `text`; other columns are ignored. Output, one row per input row: doc_id,
    n_assign, n_access, n_hex, base_sha256, spans. Spans are kind:start:end in code points, end exclusive, by
    start and then kind; the base ones always stay, high-entropy candidates that the allow list does
    not suppress are added. A null text counts as empty and has none; a null doc_id stays null; repeated rows
    give repeated results; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("__text"))
    numbers = range(len(RULES))
    rows = rows.select("*", *[_found(F.col("__text"), RULES[i][1]).alias(f"__found_{i}") for i in numbers])
    gaps = [F.when(F.size(f"__found_{i}") > 0, F.slice(F.split("__text", RULES[i][1], -1), F.lit(1), F.size(f"__found_{i}"))).alias(f"__gaps_{i}")
            for i in numbers]
    rows = rows.select("doc_id", *[f"__found_{i}" for i in numbers], *gaps)
    steps = [F.coalesce(F.zip_with(f"__found_{i}", f"__gaps_{i}", lambda m, g: (F.length(m) + F.length(g)).cast("bigint")),
                        F.array().cast("array<bigint>")).alias(f"__steps_{i}") for i in numbers]
    rows = rows.select("doc_id", *[f"__found_{i}" for i in numbers], *steps)
    rows = rows.select("doc_id", *[f"__found_{i}" for i in numbers],
                       *[running_sums(F.col(f"__steps_{i}")).alias(f"__ends_{i}") for i in numbers])
    rows = rows.select("doc_id", *[_spans(i, RULES[i][2]).alias(f"__spans_{i}") for i in numbers])
    base = F.concat(*[F.col(f"__spans_{i}") for i in range(BASE)])
    every = F.concat(*[F.col(f"__spans_{i}") for i in numbers])
    return rows.select(
        "doc_id", *[F.size(f"__spans_{i}").cast("bigint").alias(f"n_{RULES[i][0]}") for i in range(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """`docs` with every secret of `scan` replaced by `mark`, rule by rule; `n_chars` follows a changed text.

    The matches of a rule and the gaps between them are put together again in one pass. A null text stays null.
    """
    names = docs.columns
    rows = docs.withColumnsRenamed({c: f"__in_{c}" for c in names}).withColumn("__text", text_of("__in_text"))
    for _, pattern, keep in RULES:
        rows = rows.withColumn("__found", _found(F.col("__text"), pattern))
        rows = rows.withColumn("__gaps", F.when(F.size("__found") > 0, F.split("__text", pattern, -1)))
        put = F.transform("__found", (lambda m: F.when(keep(m), F.lit(mark)).otherwise(m)) if keep else (lambda m: F.lit(mark)))
        rows = rows.withColumn("__put", F.concat(put, F.array(F.lit(""))))
        parts = F.zip_with("__gaps", "__put", lambda gap, found: F.concat(gap, found))
        rows = rows.withColumn("__text", F.when(F.size("__found") > 0, F.array_join(parts, "")).otherwise(F.col("__text")))
    text = F.when(F.col("__in_text").isNotNull(), F.col("__text"))
    changed = F.col("__text") != text_of("__in_text")
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("__text").cast("bigint")).otherwise(F.col("__in_n_chars"))
    return rows.select(*[new.get(c, F.col(f"__in_{c}")).alias(c) for c in names])
