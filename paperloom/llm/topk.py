"""Exact top-k inner products by the threshold algorithm (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
#: Vectors that share sorted lists; vectors and queries of a cell.
BLOCK, GROUP, QUERIES = 8192, 131_072, 131_072
#: Entries of each list that the first round reads; each later round ends four times as deep.
DEPTH = 64
#: Scores that one product makes; vectors that queries without k others meet first, each further product has four times as many, for a k-th score to begin with.
SCORES, FIRST = 1 << 22, 32


class Best:
    """The k best so far of each of a cell's queries, all of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.own, self.vectors, self.k = ids, vectors, k
        self.weight = float(np.abs(vectors, dtype=np.float64).sum(axis=1).max(initial=0))
        self.ids, self.scores = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros(len(ids), np.int64)
        self.typed: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.vectors.astype(kind)
        return self.typed[kind]

    def enters(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Whether an id and its score are among a row's best as they stand."""
        last, least = self.ids[rows, -1], self.scores[rows, -1]
        return (ids != self.own[rows]) & ((self.filled[rows] < self.k) | (scores > least) | (scores == least) & (ids < last))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge what enters, by (score, smaller id)."""
        some = np.unique(rows)
        held, at = np.nonzero(np.arange(self.k) < self.filled[some, None])
        held = some[held]
        rows, ids, scores = np.r_[rows, held], np.r_[ids, self.ids[held, at]], np.r_[scores, self.scores[held, at]]
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(np.r_[first, len(rows)])
        rank = np.arange(len(rows)) - np.repeat(first, sizes)
        kept = rank < self.k
        self.ids[rows[kept], rank[kept]], self.scores[rows[kept], rank[kept]] = ids[kept], scores[kept]
        self.filled[rows[first]] = np.minimum(sizes, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.arange(self.k) < self.filled[:, None])
        return self.own[r], self.ids[r, c], self.scores[r, c]


class Lists:
    """A block of integer vectors with its entries sorted by each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.lists, axis=0)
        self.largest = float(np.abs(vectors, dtype=np.float64).max(initial=0))

    def search(self, best: Best) -> None:
        """Bring the queries' best up to date with this block.

        Every round reads further down each dimension's list from both ends and scores what is new in full, for all queries that go on. What a query has not
        yet seen scores at most the sum, over dimensions, of query times the last value read at the end that suits its sign; once that is below its
        k-th best score, of earlier blocks too, no unseen vector can enter and the query stops (at equality one with a smaller id could, so reading goes on).
        """
        n, top = len(self.ids), self.largest * best.weight
        # Floating point multiplies faster and is exact as long as all partial sums are whole numbers that it holds.
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        queries, vectors = best.of(kind), self.vectors.astype(kind)
        ends = self.sorted.astype(np.float64)
        live, seen, a, b = np.arange(len(best.own)), np.zeros(n, bool), 0, min(n, DEPTH)
        step = max(1, SCORES // n)
        while True:
            if kind is not np.int64:
                going = []
                for f in range(0, len(live), step):
                    part = live[f : f + step]
                    q = queries[part].astype(np.float64)
                    bound = np.maximum(q, 0) @ ends[n - max(a, 1)] + np.minimum(q, 0) @ ends[max(a, 1) - 1]
                    going.append(part[(best.filled[part] < best.k) | (bound >= best.scores[part, -1])])
                live = np.concatenate(going) if going else live
            if not len(live):
                return
            new = np.zeros(n, bool)
            new[self.lists[a:b]] = True
            new[self.lists[n - b : n - a]] = True
            at = np.flatnonzero(new & ~seen)
            seen |= new
            ours = vectors[at]
            for f in range(0, len(live), step):
                part = live[f : f + step]
                self.score(best, part, queries[part], self.ids[at], ours)
            if b >= n or seen.all():
                return
            a, b = b, min(n, 4 * b)

    @staticmethod
    def score(best: Best, part: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        f, t = 0, FIRST if (best.filled[part] < best.k).any() else len(ids)
        while f < len(ids):
            t = min(t, len(ids))
            scores = queries @ vectors[f:t].T
            least = np.where(best.filled[part] < best.k, np.iinfo(np.int64).min, best.scores[part, -1]).astype(scores.dtype)
            found = np.flatnonzero(scores >= least[:, None])
            r, c = np.divmod(found, max(1, t - f))
            rows, got, some = part[r], scores.reshape(-1)[found].astype(np.int64), ids[f:t][c]
            enters = best.enters(rows, some, got)
            if enters.any():
                best.add(rows[enters], some[enters], got[enters])
            f, t = t, 4 * t


def exact_top(queries: DataFrame, vectors: DataFrame, *, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best vectors but itself, by integer inner product of floor(scale * x), ties to the smaller id.

    Queries are dealt into parts and vectors into groups of several blocks; each pair is a cell, whose rows arrive one by one, the queries first. A task holds
    a cell's queries with their k best so far and one block of vectors with its sorted lists, and searches it for all queries together. A cell
    sends on k rows a query, and a window merges them. The query set is a stated one, against all rows.

    Vectors that are null, empty, or hold a null or a non-finite component take no part, nor do rows without an id; of rows that repeat an id the first by
    vector stays. Vectors of another length than a query's are not its candidates. Scores must stay within 64 bits. With fewer than k others all are
    returned; empty tables give an empty result. Extra columns are not read.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("v")
        bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(x.isNotNull() & (F.size(x) > 0) & ~bad)
        df = common.one_each(df, "id", order="v")
        return df.select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))

    vectors, queries = whole(vectors), whole(queries)
    # How many, and the largest and the least component, for a type that holds all.
    extent = [F.count(F.lit(1)), F.max(F.array_max("v")), F.min(F.array_min("v"))]
    (n, *ends), (asked_n, *asked_ends) = vectors.agg(*extent).first(), queries.agg(*extent).first()
    most = max((x if x >= 0 else ~x for x in (*ends, *asked_ends) if x is not None), default=0)
    narrow = "array<smallint>" if most < 1 << 15 else "array<int>" if most < 1 << 31 else "array<bigint>"
    # Enough groups for the cores, as long as the queries that are sent to each don't outweigh the vectors.
    groups = max(1, -(-n // (GROUP // BLOCK * block)), min(-(-n // block), common.cores(spark), n // max(1, asked_n)))
    parts = max(1, -(-asked_n // query_block))
    dealt = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.select(each(groups).alias("g"), dealt(parts).alias("p"), F.lit(False).alias("held"), "id", F.col("v").cast(narrow).alias("v"))
    held = vectors.select(dealt(groups).alias("g"), each(parts).alias("p"), F.lit(True).alias("held"), "id", F.col("v").cast(narrow).alias("v"))
    ddl = "query_id long, vec_id long, score long"

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(ddl)
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        best: dict[int, Best] = {}
        cell, waiting, size = None, [], 0

        def look() -> None:
            """Search the block that has come together."""
            nonlocal waiting
            if waiting:
                ids, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting = []
                if v.shape[1] not in best and v.shape[1] in asked:
                    best[v.shape[1]] = Best(*(np.concatenate(x) for x in zip(*asked.pop(v.shape[1]), strict=True)), k)
                if v.shape[1] in best:
                    for f in range(0, len(ids), block):
                        Lists(ids[f : f + block], v[f : f + block]).search(best[v.shape[1]])

        def ended() -> Iterator[pa.RecordBatch]:
            look()
            for b in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in b.rows()], schema=schema)
            asked.clear()
            best.clear()

        for batch in it:
            v, ids = batch.column("v"), batch.column("id").to_numpy()
            sizes, flat = np.diff(v.offsets.to_numpy()), v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()]
            place = np.r_[0, np.cumsum(sizes)]
            keys = np.stack([batch.column("g").to_numpy(), batch.column("p").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), sizes])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            for f, t in zip(cuts, cuts[1:], strict=False):
                g, p, is_held, d = keys[:, f].tolist()
                if (g, p) != cell:
                    yield from ended()
                    cell = (g, p)
                rows = ids[f:t].copy(), flat[place[f] : place[t]].reshape(-1, d).copy()
                if not is_held:
                    asked.setdefault(d, []).append(rows)
                    continue
                if waiting and (d != size or sum(len(x[0]) for x in waiting) >= block):
                    look()
                waiting.append(rows)
                size = d
        yield from ended()

    cells = asked.unionByName(held).repartition(max(1, 2 * groups * parts), "g", "p").sortWithinPartitions("g", "p", "held", F.size("v"))
    found = cells.mapInArrow(common.bounded(search), ddl)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
