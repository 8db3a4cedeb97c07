"""Removal of repeated byte strings by suffix arrays (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 100
#: Bytes of the string whose least hash in a window names the window's group.
GRAM = 32
#: Groups of more rows than this, whose texts differ, are dealt out window by window.
HOT_GROUP = 4000
#: Bytes of text that one suffix array covers (a group may exceed it by its own size).
BLOCK = 1 << 19
#: Bytes that are hashed at once; stretches that a task holds before it sends them; bytes that are gathered at once.
SLAB, HELD, GATHERED = 1 << 20, 1_000_000, 1 << 22

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


# ---------------------------------------------------------------- suffix array


def words(text: np.ndarray, pad: int = 128) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number; zeros follow the text."""
    n = len(text)
    buf = np.zeros(n + pad + 8, np.uint8)
    buf[:n] = text
    out = np.empty(n + pad, np.uint64)
    for s in range(8):
        part = out[s::8]
        part[:] = np.frombuffer(buf.data, ">u8", count=len(part), offset=s)
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the suffix one later; the last is not."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    differs = np.empty(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    at = np.flatnonzero(differs)
    up = np.zeros(len(at), bool)
    inner = at[:-1]
    up[:-1] = text[inner] < text[inner + 1]
    return np.repeat(up, np.diff(np.r_[-1, at]))


def sort_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the depth bytes that follow; equal ones stay as they were."""
    if not len(at):
        return at
    at = at[np.argsort(w[at], kind="stable")]
    done = 8
    first = np.r_[True, w[at[1:]] != w[at[:-1]]]
    tied = np.flatnonzero(~(first & np.r_[first[1:], True]))
    group = np.cumsum(first)[tied]
    while len(tied) and done < depth:
        dense = np.cumsum(np.r_[0, group[1:] != group[:-1]]).astype(np.uint64)  # < 2^24, as blocks are small
        take = min(5, depth - done)
        key = (dense << U(40)) | (w[at[tied] + done] >> U(64 - 8 * take))
        order = np.argsort(key, kind="stable")
        at[tied] = at[tied[order]]
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]]
        keep = ~(first & np.r_[first[1:], True])
        group, tied, done = np.cumsum(first)[keep], tied[keep], done + take
    return at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first depth bytes (as if zeros followed the text), and the eight-byte words used.

    Two stages: suffixes smaller than their successor are sorted directly; a scan of the buckets (suffixes by first byte, in
    ascending order) then puts each other suffix behind those of its bucket whose successors came earlier.
    """
    n, w = len(text), words(text, depth + 32)
    if not n:
        return np.zeros(0, np.int64), w
    small = smaller_than_successor(text)
    direct = sort_directly(np.flatnonzero(small), w, depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []

    def scan(batch: np.ndarray) -> None:
        p = batch - 1
        p = p[p >= 0]
        p = p[~small[p]]
        if not len(p):
            return
        first = text[p]
        order = np.argsort(first, kind="stable")
        p, counts = p[order], np.bincount(first, minlength=256)
        b = 0
        for c in np.flatnonzero(counts):
            induced[c].append(p[b : b + counts[c]])
            b += counts[c]

    for c in range(256):
        k = 0
        while k < len(induced[c]):  # grows while it is scanned, when a byte repeats
            batch = np.concatenate(induced[c][k:])
            k = len(induced[c])
            out.append(batch)
            scan(batch)
        batch = direct[ends[c] : ends[c + 1]]
        out.append(batch)
        scan(batch)
    return np.concatenate(out), w


def common_prefixes(at: np.ndarray, w: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position after the first, the bytes that it has in common with the one before, up to depth."""
    out = np.full(max(0, len(at) - 1), depth)
    alive = np.arange(len(out))
    for done in range(0, depth, 8):
        x = w[at[alive] + done] ^ w[at[alive + 1] + done]
        off = np.flatnonzero(x)
        same = np.zeros(len(off), np.int64)
        for k in range(1, 8):
            same += (x[off] >> U(64 - 8 * k)) == 0
        out[alive[off]] = np.minimum(depth, done + same)
        alive = alive[x == 0]
    return out


# ------------------------------------------------------------- stretches


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def powers(n: int = SLAB) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for b in (int(C1) | 1, pow(int(C1) | 1, -1, 1 << 64)):
        p = np.full(n + 256, U(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def stretches(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least gram: the gram's hash, the run's text's hash, its first window, its number of windows.

    text holds whole documents one behind the other, ends their ends. Equal windows have equal least grams (leftmost of equal
    hashes) at the same place, so they are in runs with the same gram hash.
    """
    n = len(text)
    none = np.zeros(0, np.uint64)
    if n < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    w = words(text, 64)
    h = w[:n] * C1
    for k in range(8, gram, 8):
        h ^= h >> U(29)
        h += w[k : k + n] * C2
        h *= C3
    h = mix(h)
    span = length - gram + 1
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    step = 1
    m = least
    while 2 * step <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    last = n - length + 1
    m = np.minimum(m[:last], m[span - step : span - step + last])
    place = (m & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(last + 1, np.int64)
    starts = np.r_[0, ends[:-1]]
    full = ends - starts >= length
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - length + 1, -1)
    place[np.cumsum(inside)[:last] == 0] = -1
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    cut = np.unique(np.concatenate([[0], cut, starts[starts < last]]))
    a, e = cut, np.r_[cut[1:], last]
    ok = place[a] >= 0
    a, e = a[ok], e[ok]
    up, down = powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    texts = mix((total[e + span - 1] - total[a]) * down[a] + (e - a).astype(np.uint64))
    return h[place[a]], texts, a, e - a


def slabs(keys: list[int], texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined to at most SLAB bytes: bytes, ends, ids and the offset of each part; longer documents come in parts that overlap by a window."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def join() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.cumsum([len(p[2]) for p in parts]), np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)

    for key, text in zip(keys, texts, strict=True):
        for a in range(0, max(1, len(text) - length + 1), SLAB - length):
            part = text[a : a + SLAB - 1]
            if size + len(part) > SLAB and parts:
                yield join()
                parts, size = [], 0
            parts.append((key, a, part))
            size += len(part)
    if parts:
        yield join()


SENT = "kind int, k1 long, k2 long, doc_id long, at long, n long"
STRETCH, SPAN = 0, 1


def emit(kind: int, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = common.arrow_schema(SENT)
    for b in range(0, len(doc), 1 << 16):
        s = slice(b, b + (1 << 16))
        columns = [np.full(len(doc[s]), kind, np.int32), np.ascontiguousarray(k1[s]).view(np.int64), np.ascontiguousarray(k2[s]).view(np.int64), doc[s], at[s], n[s]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted, those that touch or overlap in a document made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Ends ascend within a document once each is the largest so far; documents are kept apart by an offset.
    number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    shift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start + shift)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return doc[first], start[first], reach[last] - shift[last]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def portions(size: np.ndarray, most: int = GATHERED) -> Iterator[slice]:
    """Slices of consecutive ranges with about ``most`` members together."""
    number = np.cumsum(size) // most
    cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(size) else np.zeros(0, np.int64)
    yield from map(slice, cut.tolist(), [*cut[1:].tolist(), len(size)])


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at x are those at y."""
    out = np.ones(len(x), bool)
    for s in portions(size):
        differ = data[ranges(x[s], size[s])] != data[ranges(y[s], size[s])]
        out[s] = ~np.logical_or.reduceat(differ, np.cumsum(size[s]) - size[s])
    return out


def send_stretches(rows: list[tuple[np.ndarray, ...]], slabs_: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Equal stretches among the rows are neighbours once these are sorted; of neighbours with all bytes in common the first goes on, the others are spans that go."""
    text = np.concatenate(slabs_)
    k1, k2, doc, at, n, place = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((at, doc, k2, k1))
    k1, k2, doc, at, n, place = (x[order] for x in (k1, k2, doc, at, n, place))
    again = np.flatnonzero((k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (n[1:] == n[:-1])) + 1
    first = np.ones(len(k1), bool)
    first[again[same_bytes(text, place[again], place[again - 1], n[again] + length - 1)]] = False
    yield from emit(STRETCH, k1[first], k2[first], doc[first], at[first], n[first])
    d, a, e = joined_spans(doc[~first], at[~first], (at + n + length - 1)[~first])
    yield from emit(SPAN, mix(d.astype(np.uint64) + C1), mix(a.astype(np.uint64)), d, a, e)


def find_stretches(length: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        size = behind = 0
        for batch in it:
            keys = batch.column(0).to_pylist()
            for text, ends, ids, offsets in slabs(keys, [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], length):
                k1, k2, a, n = stretches(text, ends, length, gram)
                which = np.searchsorted(ends, a, side="right")
                held.append((k1, k2, ids[which], a - np.r_[0, ends][which] + offsets[which], n, a + behind))
                texts.append(text)
                size, behind = size + len(a), behind + len(text)
                if size >= HELD:
                    yield from send_stretches(held, texts, length)
                    held, texts, size, behind = [], [], 0, 0
        if size:
            yield from send_stretches(held, texts, length)

    return run


# --------------------------------------------------- comparing stretches

TEXTS = "key long, doc_id long, at long, n long, text binary"


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, and where each starts, with the end behind."""
    column = column.cast(pa.binary())
    offsets, data = column.buffers()[1:]
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def rows_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, data: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    text = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, doc, at, n)), text], schema=common.arrow_schema(TEXTS))


def cut_texts(length: int):
    """The text of each wanted stretch; hot ones window by window, sorted, of equal windows of a batch the first only."""

    def hot_windows(data: np.ndarray, start: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        import xxhash

        windows = sorted((data[x + p : x + p + length].tobytes(), d, a + p) for x, d, a, k in zip(start.tolist(), doc.tolist(), at.tolist(), n.tolist(), strict=True) for p in range(k))
        first = [k for k, w in enumerate(windows) if not k or w[0] != windows[k - 1][0]]
        again = [w for k, w in enumerate(windows) if k and w[0] == windows[k - 1][0]]
        schema = common.arrow_schema(TEXTS)
        for k in range(0, len(first), 1 << 14):
            part = [windows[f] for f in first[k : k + (1 << 14)]]
            yield common.batches({"key": [xxhash.xxh3_64_intdigest(w[0]) - (1 << 63) for w in part], "doc_id": [w[1] for w in part], "at": [w[2] for w in part], "n": [1] * len(part), "text": [w[0] for w in part]}, schema)
        if again:
            d, a, e = joined_spans(*(np.array(x, np.int64) for x in ([w[1] for w in again], [w[2] for w in again], [w[2] + length for w in again])))
            yield common.batches({"key": mix(d.astype(np.uint64) * C1 + a.astype(np.uint64)).view(np.int64), "doc_id": d, "at": a, "n": e, "text": [None] * len(d)}, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_numpy()
            data, offsets = binary(batch.column(1))
            wanted = batch.column(2)
            which = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            key, at, n = (flat.field(c).to_numpy() for c in ("k1", "at", "n"))
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            start, doc, size = offsets[which] + at, ids[which], n + length - 1
            cold = np.flatnonzero(~hot)
            for s in portions(size[cold]):
                c = cold[s]
                yield rows_of(key[c], doc[c], at[c], n[c], data[ranges(start[c], size[c])], size[c])
            if hot.any():
                yield from hot_windows(data, start[hot], doc[hot], at[hot], n[hot])

    return run


def repeated_windows(text: np.ndarray, start: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows of stretches (at start in text) that equal an earlier one (by document, then place)."""
    which = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    row = np.full(len(text), -1, np.int64)
    row[start[which] + within] = np.arange(len(which))
    order, w = suffix_array(text, length)
    order = order[row[order] >= 0]
    whole = common_prefixes(order, w, length) >= length
    wdoc, wat = doc[which], at[which] + within
    rank = np.empty(len(which), np.int64)
    rank[np.lexsort((wat, wdoc))] = np.arange(len(which))
    rows = row[order]
    first = np.flatnonzero(np.r_[True, ~whole])
    least = np.repeat(np.minimum.reduceat(rank[rows], first), np.diff(np.r_[first, len(rows)]))
    gone = rows[rank[rows] != least]
    return joined_spans(wdoc[gone], wat[gone], wat[gone] + length)


SPANS = "doc_id long, start long, stop long"


class Group:
    """Rows of a batch with different texts: key, doc, at, n, the bytes of all texts and each one's size."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
        self.key, self.doc, self.at, self.n, self.data, self.size = key, doc, at, n, data, size

    def part(self, rows: np.ndarray) -> Group:
        start = np.cumsum(self.size) - self.size
        return Group(self.key[rows], self.doc[rows], self.at[rows], self.n[rows], self.data[ranges(start[rows], self.size[rows])], self.size[rows])

    @staticmethod
    def joined(groups: list[Group]) -> Group:
        return Group(*(np.concatenate([getattr(g, c) for g in groups]) for c in ("key", "doc", "at", "n", "data", "size")))


def compare(length: int, block: int):
    """Stretches sorted by key and text: neighbours with all bytes in common are equal, so that the later ones are spans that go. The different
    texts of a key go through a suffix array, blocks of whole groups at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(SPANS)

        def spans(d: np.ndarray, a: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, a, e)], schema=schema)

        def arrays(g: Group) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, g.key[1:] != g.key[:-1]])
            many = np.diff(np.r_[first, len(g.key)]) > 1
            g = g.part(np.flatnonzero(np.repeat(many, np.diff(np.r_[first, len(g.key)]))))
            if not len(g.key):
                return
            first = np.flatnonzero(np.r_[True, g.key[1:] != g.key[:-1]])
            for s in portions(np.add.reduceat(g.size, first), block):
                p = g.part(np.arange(first[s.start], first[s.stop] if s.stop < len(first) else len(g.key)))
                yield spans(*repeated_windows(p.data, np.cumsum(p.size) - p.size, p.doc, p.at, p.n, length))

        held: list[Group] = []
        size = 0
        last: tuple[int, bytes] | None = None
        for batch in it:
            has = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(k).to_numpy() for k in range(4)]
            if not has.all():
                yield spans(*(c[~has] for c in columns[1:]))
                if not has.any():
                    continue
            data, offsets = binary(batch.column(4))
            key, doc, at, n = (c[has] for c in columns)
            start, sizes = offsets[:-1][has], np.diff(offsets)[has]
            again = np.flatnonzero((key[1:] == key[:-1]) & (sizes[1:] == sizes[:-1])) + 1
            again = again[same_bytes(data, start[again], start[again - 1], sizes[again])]
            first = np.ones(len(key), bool)
            first[again] = False
            texts = lambda k: (int(key[k]), data[start[k] : start[k] + sizes[k]].tobytes())  # noqa: B023, E731
            first[0] = last != texts(0)
            last = texts(-1)
            if not first.all():
                yield spans(*joined_spans(doc[~first], at[~first], (at + n + length - 1)[~first]))
            f = np.flatnonzero(first)
            held.append(Group(key[f], doc[f], at[f], n[f], data[ranges(start[f], sizes[f])], sizes[f]))
            size += len(held[-1].data)
            if size >= 4 * block:
                g = Group.joined(held)
                done = g.key != last[0]
                yield from arrays(g.part(np.flatnonzero(done)))
                held = [g.part(np.flatnonzero(~done))]
                size = len(held[0].data)
        if held:
            yield from arrays(Group.joined(held))

    return run


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str, unique_ids: bool) -> DataFrame:
    return common.one_each(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", order="text", unique=unique_ids)


def repeated_spans(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot_group: int = HOT_GROUP, block: int = BLOCK) -> DataFrame:
    """doc_id, start, stop of rows (doc_id, each once, and text): byte spans covered by strings of ``length`` bytes that start earlier too (smaller id, or same document and earlier). Spans may overlap or touch.

    1. Every window belongs to the run of windows around its least gram, so equal windows are in runs with the same gram. Hashes say only which
       runs meet. A task sends the first of runs whose bytes are the same.
    2. Runs whose gram has other runs are fetched with their text (join by document), meet by gram and are sorted by text, so suffixes that
       start at a run are in order: neighbours whose common prefix is all of the run are equal. The different texts of a gram are put
       through a two-stage suffix array; adjacent common prefixes of ``length`` and more make the groups of equal windows.
       Groups of over ``hot_group`` runs with different texts meet window by window instead, so none grows with the input.
    """
    spark = rows.sparkSession
    sent = rows.mapInArrow(common.bounded(find_stretches(length, gram)), SENT)
    of_gram = Window.partitionBy("k1")
    counted = sent.withColumn("c", F.count(F.lit(1)).over(of_gram)).withColumn("differ", F.min("k2").over(of_gram) != F.max("k2").over(of_gram))
    is_span = F.col("kind") == SPAN
    found = common.table(counted.where(is_span | (F.col("c") > 1)).select(is_span.alias("is_span"), "k1", "doc_id", "at", "n", ((F.col("c") > hot_group) & F.col("differ")).alias("hot")), "stretches")
    spans = found.where("is_span").select("doc_id", F.col("at").alias("start"), F.col("n").alias("stop"))
    wanted = found.where("not is_span").groupBy("doc_id").agg(F.collect_list(F.struct("k1", "at", "n", "hot")).alias("wanted"))
    texts = rows.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(common.bounded(cut_texts(length)), TEXTS)
    more = texts.repartition(common.cores(spark), "key").sortWithinPartitions("key", "text", "doc_id", "at").mapInArrow(common.bounded(compare(length, block)), SPANS)
    return spans.unionByName(common.table(more, "spans"))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def keep_rest(least: int = 1, whole: bool = False):
    """Bytes outside the spans. Spans that meet are one run; runs shorter than ``least`` stay, unless they are the whole text. ``whole``: parts of characters that a cut has left go too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(KEPT)
        for batch in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, runs = text or b"", []
                for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                runs = [r for r in runs if r[1] - r[0] >= min(least, len(text))]
                left = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)], strict=True))
                kept = left.decode("utf-8", "ignore").encode() if whole and runs else left
                for name, value in zip(out, (key, len(text), len(text) - len(left), len(runs), kept), strict=True):
                    out[name].append(value)
            yield common.batches(out, schema)

    return run


def dedup(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", unique_ids: bool = False, whole: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay; with ``whole``, without parts of characters that a cut has left) of each document.

    Null text counts as empty, and texts shorter than ``length`` stay whole. Rows without an id are left out; of rows that repeat
    an id the one with the smallest text (null last) stays. Empty tables give an empty result; extra columns are not read.
    """
    rows = ids_and_texts(docs, id_col, text_col, unique_ids)
    # What is joined to the texts grows with them, so both joins are by merge at every size.
    spans = repeated_spans(rows, length=length, **how)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(common.bounded(keep_rest(whole=whole)), KEPT)
