"""N-gram Jaccard join: hashed bitmap signatures, size bands, exact intersections (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .suffix import C1, C2, SLAB, U, mix, powers

SHINGLE = 5
#: Least Jaccard similarity, in hundredths.
PERCENT = 80
#: 64-bit words of a bitmap signature.
WORDS = 16
#: Rows of a tile; members that are compared with one hub in a task.
TILE, CHUNK = 512, 128
#: Candidate pairs that a task holds to send each once.
HELD_PAIRS = 1_000_000
#: A shingle in over this part of a task's documents is counted; so many of the most frequent ones come last in the order that prefixes follow.
COMMON, LATE = 5e-4, 200_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A 64-bit number for each byte, from a seeded generator.
BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of folded bytes, and where each starts."""
    text = np.frombuffer(data, np.uint8)
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    n = len(text)
    up, down = powers() if n <= SLAB else powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[text] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * C2), start


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each text. A text of fewer words is one shingle; one without words has none."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        h, start = word_hashes(b" ".join(group).translate(FOLD))
        bounds = np.r_[0, np.searchsorted(start, np.cumsum([len(t) + 1 for t in group]))]
        s = h
        if len(h) >= size:
            s = h[: len(h) - size + 1]
            for k in range(1, size):
                s = mix(s * C1 + h[k : len(h) - size + 1 + k])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            else:
                x = np.full(min(1, b - a), U(b - a))
                for k in range(a, b):
                    x = mix(x * C2 + h[k : k + 1])
                yield x

    for t in texts:
        if group and held + len(t) > SLAB - 4096:
            yield from flush()
            group, held = [], 0
        group.append(t)
        held += len(t) + 1
    if group:
        yield from flush()


def raw(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


SUMMARY = "kind int, doc_id long, n long, d1 long, d2 long"
DOC, TOKEN = 0, 1


def summarise(size: int):
    """Per document: number of shingles and a 128-bit digest of the set. Per task: shingles of several documents and how many of the task's have them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        schema = common.arrow_schema(SUMMARY)
        held: list[np.ndarray] = []
        count, docs = 0, 0

        def often() -> Iterator[pa.RecordBatch]:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(3, docs * COMMON)
            k = int(keep.sum())
            columns = [np.full(k, TOKEN, np.int32), np.zeros(k, np.int64), n[keep], tokens[keep].view(np.int64), np.zeros(k, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in it:
            sets = list(shingle_sets(raw(batch), size))
            digests = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            columns = [np.full(len(sets), DOC, np.int32), batch.column(0), np.array([len(s) for s in sets], np.int64), digests[:, 0].copy(), digests[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for s in sets:
                held.append(s)
                count, docs = count + len(s), docs + 1
                if count >= 4_000_000:
                    yield from often()
                    held, count, docs = [], 0, 0
        if held:
            yield from often()

    return run


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that must hold one that any similar set has among its own first ones, under any one order of all shingles."""
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bits at the shingles' hashed places: sets that differ in d shingles differ in at most d bits."""
    out = np.zeros(words * 64, np.uint8)
    out[((s * C2) >> U(40)) % U(words * 64)] = 1
    return np.packbits(out).view(np.int64)


def wide_bitmap(s: np.ndarray) -> bytes:
    """The same with at least as many bits as shingles, a power of two of them, for sets that fill a small bitmap."""
    bits = max(512, 1 << (len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[mix(s) & U(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide bitmaps differ, the longer one folded."""
    a, b = (np.frombuffer(z, np.uint64) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    return int(np.bitwise_count(a ^ np.bitwise_or.reduce(b.reshape(-1, len(a)))).sum())


PREFIX = "doc_id long, n long, bits array<long>, wide binary, prefix array<long>"


def prefixes(size: int, percent: int, late):
    """Size, bitmap and prefix of each document's set; shingles in ``late`` come after all others."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, hot = common.arrow_schema(PREFIX), late.value
        for batch in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(raw(batch), size), strict=True):
                if not len(s):
                    continue
                at = np.searchsorted(hot, s)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                first = np.r_[s[~is_hot], s[is_hot]][: prefix_length(len(s), percent)]
                for name, value in zip(out, (key, len(s), bitmap(s), wide_bitmap(s), first.view(np.int64)), strict=True):
                    out[name].append(value)
            yield common.batches(out, schema)

    return run


LINKS = "a long, b long"


def size_fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def bound_fits(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether the bitmaps allow the similarity: the overlap is at most (n + m - differing bits) / 2, and at least percent (n + m) / (100 + percent)."""
    apart = sum((F.bit_count(F.element_at(x, k + 1).bitwiseXOR(F.element_at(y, k + 1))) for k in range(WORDS)), F.lit(0))
    return (n + m - apart) * (100 + percent) >= 2 * percent * (n + m)


def prune(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sizes and bitmaps allow the similarity."""
    x = held.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    y = held.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    n, m = F.col("n_a"), F.col("n_b")
    return pairs.join(x, "a").join(y, "b").where(size_fits(n, m, percent) & bound_fits(n, m, F.col("x"), F.col("y"), percent)).select("a", "b")


def prune_wide(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose wide bitmaps allow the similarity."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(LINKS)
        for batch in it:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            kept = [(a, b) for a, b, n, m, x, y in rows if (n + m - bits_apart(x, y)) * (100 + percent) >= 2 * percent * (n + m)]
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], pa.int64()) for c in (0, 1)], schema=schema)

    x = held.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("x"))
    y = held.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(common.bounded(run), LINKS)


SHIPPED = "hub long, part int, role int, doc_id long, text binary"


def ship(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    schema = common.arrow_schema(SHIPPED)
    for batch in it:
        out: dict[str, list] = {f.name: [] for f in schema}
        for key, text, wanted in zip(batch.column(0).to_pylist(), raw(batch), batch.column(2).to_pylist(), strict=True):
            small = squeeze.compress(text)
            for w in wanted:
                for name, value in zip(out, (w["hub"], w["part"], w["role"], key, small), strict=True):
                    out[name].append(value)
        yield common.batches(out, schema)


def intersect(size: int, percent: int):
    """Rows sorted by hub, part, role: the hub's set, then its members', which are intersected with it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        schema = common.arrow_schema(LINKS)
        hub: tuple[int, int] | None = None
        own = np.zeros(0, np.uint64)
        for batch in it:
            links: tuple[list, list] = [], []
            sets = shingle_sets([grow.decompress(t) for t in batch.column(4).to_pylist()], size)
            for h, part, role, key, s in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
                if role == 0:
                    hub, own = (h, part), s
                    continue
                assert hub == (h, part)  # noqa: S101
                n, m = len(own), len(s)
                if min(n, m) * 100 < max(n, m) * percent:
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both * 100 >= percent * (n + m - both):
                    links[0].append(h)
                    links[1].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], schema=schema)

    return run


def verify(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs a, b that link, by exact intersection. A hub with many members is sent to as many parts as it has chunks of them."""
    spark = rows.sparkSession
    pairs = common.table(pairs, "pairs")
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    wide = pairs.join(degree.where("parts > 1"), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    members = wide.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "part", F.lit(1).alias("role"))
    hubs = degree.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = members.unionByName(hubs).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part", "role")).alias("wanted"))
    sent = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(common.bounded(ship), SHIPPED)
    sent = sent.repartition(common.cores(spark), "hub", "part").sortWithinPartitions("hub", "part", "role", "doc_id")
    links = common.table(sent.mapInArrow(common.bounded(intersect(size, percent)), LINKS), "links")
    return links


def place_fits(n: Column, at: Column, m: Column, to: Column, percent: int) -> Column:
    """Whether a shingle at these places of two ordered sets can be the first that they share: all that they share comes from there on. Similar sets pass at their first."""
    return F.least(n - at, m - to) * (100 + percent) >= percent * (n + m)


TILES = "key long, side int, upper int, doc_id long, n long, pos int, component long, bits array<long>"


def candidate_pairs(key: np.ndarray, side: np.ndarray, upper: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, component: np.ndarray, bits: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key that may link, groups of equal size at once: of different components, not both of the upper band, and places, sizes and bitmaps allow it."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    for g in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(g, 1)
        at = start[size == g]
        some = max(1, 1_000_000 // len(i))
        for k in range(0, len(at), some):
            x, y = ((at[k : k + some, None] + z).ravel() for z in (i, j))
            ok = (component[x] != component[y]) & ((upper[x] == 0) | (upper[y] == 0)) & ((side[x] == 0) | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            total = n[x] + n[y]
            ok = (np.minimum(n[x] - pos[x], n[y] - pos[y]) * (100 + percent) >= percent * total) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y, total = x[ok], y[ok], total[ok]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = (total - apart) * (100 + percent) >= 2 * percent * total
            pair = np.unique(np.stack([np.minimum(doc[x[ok]], doc[y[ok]]), np.maximum(doc[x[ok]], doc[y[ok]])]), axis=1)
            yield pair[0], pair[1]


def compare_tiles(percent: int):
    """Rows sorted by key: those that may link, each pair once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(LINKS)
        rest: list[np.ndarray] = []

        found: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            x, y = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=schema)

        for batch in it:
            bits = batch.column(7).flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
            rows = [*(batch.column(k).to_numpy().astype(np.int64) for k in range(7)), bits]
            if rest:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            last = int(np.max(np.flatnonzero(rows[0] != rows[0][-1]), initial=-1)) + 1
            for pair in candidate_pairs(*(x[:last] for x in rows), percent):
                found.append(np.stack(pair))
                size += found[-1].shape[1]
                if size > HELD_PAIRS:  # a pair comes up once for each shingle that it shares: most are seen again in the task
                    yield send()
                    found, size = [], 0
            rest = [x[last:] for x in rows]
        if rest:
            found += [np.stack(pair) for pair in candidate_pairs(*rest, percent)]
        yield send()

    return run


def banded(members: DataFrame, percent: int) -> DataFrame:
    """Each member (token, doc_id, n, pos) in its token's tiles by size: that of its own band and, as one of the upper band, the one below.

    Bands grow by 100 / percent, so sets of the sizes that similarity allows are of one band or of neighbouring ones and meet in the tile
    of the smaller: that tile, and no other, has the pair.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    tiles = F.array(F.struct(band.alias("band"), F.lit(0).alias("upper")), F.struct((band - 1).alias("band"), F.lit(1).alias("upper")))
    return members.select("token", "doc_id", "n", "pos", F.explode(tiles).alias("tile")).select("token", "tile.band", "tile.upper", "doc_id", "n", "pos")


def hubs(tiles: DataFrame) -> DataFrame:
    """token, band, members and hub, the smallest member of the own band, of each tile that can hold a pair."""
    own = F.when(F.col("upper") == 0, F.struct("doc_id", "n", "pos"))
    return tiles.groupBy("token", "band").agg(F.count(F.lit(1)).alias("members"), F.min(own).alias("hub")).where("members > 1 and hub is not null")


def dealt(tiles: DataFrame) -> DataFrame:
    """The tiles' rows by key. Up to TILE members share one key; more are cut by hash, and each pair of cuts is a key, in which side 0 meets itself
    and 1 meets 2."""
    cuts = F.ceil(F.col("members") / TILE).cast("int")
    rows = tiles.withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    side = lambda j: F.when(j == F.col("cut"), 0).when(j > F.col("cut"), 1).otherwise(2)
    keys = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.xxhash64("token", "band", F.least(j, F.col("cut")), F.greatest(j, F.col("cut"))).alias("key"), side(j).alias("side")))
    return rows.withColumn("at", F.explode(keys)).select("at.key", "at.side", "upper", "doc_id", "n", "pos", "component", "bits")


def pairs_in(tiles: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of members of a tile, of different components, whose bitmaps allow the similarity."""
    rows = dealt(tiles.join(held.select("doc_id", "bits"), "doc_id")).repartition(common.cores(held.sparkSession), "key").sortWithinPartitions("key")
    return prune_wide(rows.mapInArrow(common.bounded(compare_tiles(percent)), LINKS).distinct(), held, percent)


def prepared(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, unique_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents, their sets' sizes and digests, classes of equal sets, prefixes and bitmaps of one document a class, and members of tokens that several of these have."""
    spark = docs.sparkSession
    rows = common.one_each(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", order="text", unique=unique_ids)
    found = common.table(rows.mapInArrow(common.bounded(summarise(size)), SUMMARY), "sets")
    sums = found.where(F.col("kind") == DOC).select("doc_id", "n", "d1", "d2")
    classes = common.table(sums.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    # Any order of shingles gives right prefixes if all documents follow it; putting the most frequent ones last keeps groups small.
    often = found.where(F.col("kind") == TOKEN).groupBy("d1").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "d1").limit(LATE)
    late = spark.sparkContext.broadcast(np.sort(np.array([r["d1"] for r in often.select("d1").collect()], np.int64).view(np.uint64)))  # at most LATE numbers
    reps = classes.select(F.col("class_id").alias("doc_id"))
    held = common.table(rows.join(reps, "doc_id").select("doc_id", "text").mapInArrow(common.bounded(prefixes(size, percent, late)), PREFIX), "prefixes")
    tokens = held.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("token")
    return rows, sums, classes, held, common.table(tokens.join(shared, "token"), "members")


def similar_pairs(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", unique_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """All links between class representatives (a, b), and the membership (doc_id, class_id) of every document in a class of equal sets.

    Every pair of a tile is looked at, so the work follows the number of links, which ``join`` avoids by components. Inputs as in ``join``.
    """
    rows, sums, classes, held, members = prepared(docs, size, percent, id_col, text_col, unique_ids)
    tiles = banded(members, percent)
    links = verify(pairs_in(tiles.join(hubs(tiles), ["token", "band"]).withColumn("component", F.col("doc_id")), held, percent), rows, size, percent)
    return links, sums.join(classes, ["d1", "d2", "n"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def join(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", unique_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id: near-duplicate components of documents by the Jaccard similarity of their word shingles.

    1. Documents with equal sets are one class (its smallest id); only class representatives go on.
    2. Members of a tile share a shingle of their prefixes, under an order of all shingles that puts the most frequent ones (counted over all
       documents) last, and are of one band of sizes or the next (``banded``). A tile's smallest member is its hub: pairs of hubs and members
       that sizes, places of the shingle and bitmaps allow are intersected exactly.
    3. In tiles that these links leave in several components all remaining pairs are looked at: bitmaps bound the overlap from above, and
       what passes is intersected exactly. Pairs that are in one component already need no test.

    Null and empty texts, and those without words, have no shingles and are linked with nothing. Rows without an id are left out; of rows that repeat
    an id the one with the smallest text (null last) stays. Empty tables give an empty result; extra columns are not read.
    """
    rows, sums, classes, held, members = prepared(docs, size, percent, id_col, text_col, unique_ids)
    tiles = banded(members, percent)
    tiles = common.table(tiles.join(hubs(tiles), ["token", "band"]), "tiles")
    may_link = place_fits(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent) & size_fits(F.col("n"), F.col("hub.n"), percent)
    stars = tiles.where((F.col("doc_id") != F.col("hub.doc_id")) & may_link).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = verify(prune_wide(prune(stars, held, percent), held, percent), rows, size, percent)
    first = components(links, "a", "b")
    placed = tiles.where("members > 2").join(first.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = placed.groupBy("token", "band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token", "band")
    more = verify(pairs_in(placed.join(split, ["token", "band"], "left_semi"), held, percent), rows, size, percent)
    linked = components(links.unionByName(more), "a", "b")
    of_class = classes.join(linked.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("d1", "d2", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sums.join(of_class, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
