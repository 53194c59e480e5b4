"""Byte-level BPE encoding and decoding with a local rank file.

Every text is encoded whole. Long texts are first cut at safe boundaries, places where no match of
the splitting pattern can reach across, so that no call sees more than a bounded stretch; decoding
joins the raw bytes of the ids and never goes through a lossy string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import map_texts, text_of

CHUNK_CHARS = 100_000
# White_Space of Unicode, as the splitting pattern sees it (fixed values)
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")
LONG_BLANK = re.compile("[" + "".join(map(chr, BLANKS)) + "]{4096,}")


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file's bytes, without special tokens."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK_CHARS):
    """Parts of `text` of about `size` characters whose encodings join to that of the whole.

    The pattern never matches a visible character followed by a blank, so any such place is a match
    boundary. A stretch without one stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of the whole text.

    Very long runs of blanks exceed the library's regex stack; their one match (all but the last
    blank where a visible character follows, otherwise the whole run) is encoded as a single piece.
    """
    if len(text) < 4096:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_BLANK.finditer(text):
        for part in safe_chunks(text[at:run.start()]):
            ids += enc.encode_ordinary(part)
        at = run.end() - (run.end() < len(text))
        ids += enc._encode_single_piece(text[run.start():at].encode())
        if at < len(text) and text[at] != " ":  # only a space joins the next match
            ids += enc._encode_single_piece(text[at].encode())
            at += 1
    for part in safe_chunks(text[at:]):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, keep_ids: bool = True) -> DataFrame:
    """Token ids of every text, and digests that prove the round trip.

    Input needs `doc_id` and `text`; other columns are ignored. Output, one row per input row:
    doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `keep_ids`, ids (array of int).
    A null text counts as empty: no ids, digests of the empty string. A null doc_id stays null,
    repeated rows give repeated results, an empty table an empty result.

    The rank file is read once on the driver and broadcast: its size is that of the vocabulary.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        names = decimal_names(enc.n_vocab)
        counts, ids_sha, text_sha, kept = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode_text(enc, text)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            if keep_ids:
                kept.append(ids)
        out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            out.append(pa.array(kept, pa.list_(pa.int32())))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(out, names=fields)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return map_texts(source, ["doc_id", "text"], schema, rows)


@lru_cache(maxsize=2)
def decimal_names(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids: cuts inside a character survive."""
    return enc.decode_bytes(ids)
