"""Removal of repeated substrings by content-defined chunks (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, suffix

#: A cut falls where this many leading bits of the rolling hash are zero; chunks hold LEAST to MOST bytes, the last of a text fewer. LEAST guards against chance repeats.
BITS, LEAST, MOST = 5, 16, 256
SEED = 11
HELD = 500_000

#: The gear table: 256 numbers of 32 bits from a seeded generator.
GEAR = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(text: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[byte k before] << k over the last 32 bytes, by doubling."""
    h = GEAR[text]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(text: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks. A cut depends on the 32 bytes before it and on where the last cut was, so cuts fall into step again soon after an edit."""
    n = len(text)
    out, last = [], 0
    for c in (np.flatnonzero(rolling(text) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last += most
        out.append(last)
    if n > last:
        out.append(n)
    return out


SENT = "kind int, k1 long, k2 long, doc_id long, at long, n long"
CHUNK, SPAN = 0, 1


def find_chunks(bits: int, least: int, most: int):
    """The first of equal chunks in a task goes on, by digest; the others are spans that go."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        digests: list[bytes] = []
        doc: list[int] = []
        at: list[int] = []
        n: list[int] = []

        def send() -> Iterator[pa.RecordBatch]:
            k = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            k1, k2 = k[:, 0].copy(), k[:, 1].copy()
            d, a, s = (np.array(x, np.int64) for x in (doc, at, n))
            order = np.lexsort((a, d, k2, k1))
            k1, k2, d, a, s = k1[order], k2[order], d[order], a[order], s[order]
            first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            yield from suffix.emit(CHUNK, k1[first], k2[first], d[first], a[first], s[first])
            rest = ~first
            yield from suffix.emit(SPAN, suffix.mix(d[rest].astype(np.uint64) + suffix.C1), suffix.mix(a[rest].astype(np.uint64)), d[rest], a[rest], (a + s)[rest])

        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                a = 0
                for e in cuts(np.frombuffer(text, np.uint8), bits, least, most):
                    digests.append(blake2b(text[a:e], digest_size=16).digest())
                    doc.append(key)
                    at.append(a)
                    n.append(e - a)
                    a = e
                if len(doc) >= HELD:
                    yield from send()
                    digests.clear(), doc.clear(), at.clear(), n.clear()
        if doc:
            yield from send()

    return run


def repeated_chunks(docs: DataFrame, *, bits: int = BITS, least: int = LEAST, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop of each chunk whose bytes are those of an earlier chunk (smaller id, or same document and earlier), by 128-bit BLAKE2 digest.

    A digest has at most one row a task in the shuffle, however many copies there are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(common.bounded(find_chunks(bits, least, most)), SENT)
    first = F.min(F.struct("doc_id", "at")).over(Window.partitionBy("k1", "k2"))
    marked = sent.withColumn("first", first)
    gone = (F.col("kind") == SPAN) | (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.at") != F.col("at"))
    return marked.where(gone).select("doc_id", F.col("at").alias("start"), F.when(F.col("kind") == SPAN, F.col("n")).otherwise(F.col("at") + F.col("n")).alias("stop"))


def dedup(docs: DataFrame, *, run: int = 1, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept of each document: every chunk whose digest occurs earlier goes.

    A caller may ask that repeated chunks stay where neighbouring ones make up fewer than ``run`` bytes and not the whole text; the query does not.

    Null and empty texts have no chunks and stay. Rows without an id are left out; of rows that repeat an id the one with the smallest text
    (null last) stays. Empty tables give an empty result; extra columns are not read.
    """
    rows = common.one_each(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", order="text")
    by_doc = repeated_chunks(rows, **how).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(by_doc, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(common.bounded(suffix.keep_rest(run)), suffix.KEPT)
