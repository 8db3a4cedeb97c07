"""Token counts by section, from character offsets of one encoding a document (operator 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RULES = ("first", "last", "most")
SECTIONS = "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A byte-level encoding from a file of base64 tokens and ranks, and each token's number of bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def spans(text: str, enc, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token of the whole text. Tokens are byte strings that make up the text, so ends are sums of sizes; a token that holds a part of a character touches it."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes[np.array(enc.encode_ordinary(text), np.int64)])
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return char[starts], char[ends - 1]


def sections(text: str) -> np.ndarray:
    """Starts of the lines, each with the line feed that ends it; at least one section."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.r_[0, at[at < len(text)]]


def allot(first: np.ndarray, last: np.ndarray, starts: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach into another one.

    A token on a boundary belongs whole to one section, so sums are exact: that of its first character, of its last, or the
    one that holds most of its characters (the earliest of equals).
    """
    a, b = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, last, side="right") - 1
    own = b if rule == "last" else a
    crossing = np.flatnonzero(a != b)
    if rule == "most":
        own = a.copy()
        ends = np.r_[starts[1:], n_chars]
        for t in crossing:
            held = [min(last[t] + 1, ends[s]) - max(first[t], starts[s]) for s in range(a[t], b[t] + 1)]
            own[t] = a[t] + int(np.argmax(held))
    n = len(starts)
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def count_by_section(docs: DataFrame, tokenizer: str, pattern: str, *, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document: its characters [start, stop), the tokens allotted to it, how many of them reach over its edge, and the document's tokens.

    Rows are independent of each other, so nothing is shuffled. Null and empty texts have one empty section without tokens; bytes that are not UTF-8 read as U+FFFD;
    rows with null or repeated ids are counted like any other. Extra columns are not read.
    """
    if rule not in RULES:
        raise ValueError(rule)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(tokenizer, pattern)
        schema = common.arrow_schema(SECTIONS)
        for batch in it:
            ids, out, rows = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)), strict=True):
                starts = sections(text)
                first, last = spans(text, enc, sizes)
                n, over = allot(first, last, starts, len(text), rule)
                k = len(starts)
                ids += [key] * k
                out.append(np.stack([np.arange(k), starts, np.r_[starts[1:], len(text)], n, over, np.full(k, len(first))]))
                rows.append(k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x) for x in np.concatenate(out, axis=1))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(common.bounded(run), SECTIONS)
