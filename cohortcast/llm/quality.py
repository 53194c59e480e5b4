"""Quality rules, line first: drop failing lines, then reject documents that lose too much text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import map_texts, text_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
# line-level rules (fixed values); letters and word edges are ASCII ones
BOILERPLATE = re.compile(
    r"(?ai)all rights reserved|©|\bcopyright\b|cookie (?:policy|settings|notice)|terms (?:of|and) (?:use|service|conditions)"
    r"|privacy policy|click here|subscribe (?:now|to)|sign (?:in|up)\b|log in\b|lorem ipsum|javascript|licensed under"
    r"|\blicen[cs]e\b")
NAVIGATION = re.compile(r"(?ai)^(?:home|menu|search|next|previous|back|top|share|login|contact(?: us)?|about(?: us)?|skip to .*)$")
NAV_SEPARATOR = re.compile(r"(?a)[|›»·•]|\s[-/>]\s")
CLOSERS = "\"'”’»)]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document verdict."""
    end_marks: str = ".!?…:;"
    max_symbol_share: float = 0.1        # of the visible characters
    max_exclaim_share: float = 0.34      # of the words end in !
    nav_separators: int = 2
    open_line_words: int = 60            # a line this short must end in a mark
    max_lost_share: float = 0.5          # of the text's characters in lines with words
    min_words: int = 50
    max_repeat_percent: int = 50


def line_fails(line: str, n_words: int, rules: LineRules) -> bool:
    """Whether a line with words breaks a navigation, boilerplate or punctuation rule."""
    body = line.strip(BLANKS)
    bare = body.rstrip(CLOSERS)
    if NAVIGATION.match(bare) or BOILERPLATE.search(body):
        return True
    if len(NAV_SEPARATOR.findall(body)) >= rules.nav_separators and n_words <= 12:
        return True
    visible = len(body) - sum(map(body.count, BLANKS))
    if sum(map(body.count, SYMBOLS)) > rules.max_symbol_share * visible:
        return True
    if body.count("!") > rules.max_exclaim_share * n_words and n_words > 2:
        return True
    return n_words < rules.open_line_words and not bare.endswith(tuple(rules.end_marks))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    span = len(known)
    _, pair = np.unique(ids[:-1] * span + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1].astype(np.int64) * span + ids[2:], return_inverse=True, return_counts=True)
    hit = times[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: str, rules: LineRules) -> tuple[int, int, int, int, int, bool, bool, str]:
    """Counts, base verdict, verdict and the text without its failing lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dups = total = lost = 0
    kept_lines = []
    for line in text.split("\n"):
        count = len(line.encode("utf-8", "surrogatepass").split())
        if not count:
            kept_lines.append(line)
            continue
        dups += line in seen
        seen.add(line)
        total += len(line)
        if line_fails(line, count, rules):
            lost += len(line)
        else:
            kept_lines.append(line)
    repeats = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    kept = not failed and lost <= rules.max_lost_share * total
    return len(words), word_chars, symbols, dups, repeats, failed, kept, "\n".join(kept_lines)


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), *, keep_text: bool = True) -> DataFrame:
    """Line-first cleaning of every text.

    Input needs `doc_id` and `text`; other columns are ignored. Output, one row per input row: doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and, with
    `keep_text`, clean_text: the text without the lines that fail. A null or empty text has no
    words, fails the base rule and is not kept. A null doc_id stays null; repeated rows give repeated results.
    Each document is measured alone, so no key can be hot and nothing is shuffled.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
    if keep_text:
        names, kinds = names + ["clean_text"], kinds + [pa.string()]
    sql = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [measure(text, rules)[:len(names)] for text in batch.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    schema = ", ".join(["doc_id bigint", *(f"{n} {sql[k]}" for n, k in zip(names, kinds))])
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return map_texts(source, ["doc_id", "text"], schema, rows)
