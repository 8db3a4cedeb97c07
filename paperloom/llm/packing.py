"""Sequence packing by non-negative least squares (operator 5)."""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
#: Lengths are told apart in steps of so many tokens.
STEP = 16
#: Lengths in a combination that the solver may use.
DEPTH = 3
END_ID = 2
#: Pieces of up to SHORT tokens are counted by their exact length and bundled, pieces of one length to at most BUNDLE tokens.
SHORT, BUNDLE = 128, 512
#: Pieces that are ranked in one task.
RANKED = 1_000
#: Characters that are encoded together.
GROUP_CHARS = 1_000_000

# The tokenizer file's word end and split rules, for the characters of PLAIN.
WORD_END = "</w>"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: ASCII and Latin letters: what the tokenizer does to them is to fold case and to split by kind.
PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]*")
BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
BLANK, LETTER, DIGIT, MARK = range(4)
KINDS = np.array([BLANK if b == 32 else LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)
#: Ends a text among several; no plain text holds it.
STOP = "\x01"


class WordEncoder:
    """Ids of texts under a byte-pair tokenizer whose words end in a mark, exactly as ``tokenizers`` gives them.

    No token spans a blank, so a text's ids are those of its blank-separated words. A plain text is folded, parted where the
    tokenizer's pattern parts it, by kinds of bytes, and each word is followed by one blank, which stands for the word end.
    Pairs merge in the order of the file's merges, and a pair's place there is its token's id, so the same vocabulary with blanks for
    word ends gives the same ids in ``tiktoken``. A word with any other character goes through the tokenizer itself.
    Nothing is kept from text to text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        ranks = {bytes(byte_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END): i for t, i in vocabulary.items()}
        self.words = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={STOP * 3: max(ranks.values()) + 1})
        self.stop = ranks[STOP.encode() + b" "]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        data = np.frombuffer(f" {STOP} ".join([*texts, ""]).lower().encode().translate(BLANKS), np.uint8)
        kind = KINDS[data]
        edge = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        for at in np.flatnonzero(data[:-1] == ord("'")).tolist():  # a contraction is one word where a word may begin
            if at == 0 or kind[at - 1] != MARK:
                for c in CONTRACTIONS:
                    if data[at : at + len(c)].tobytes() == c.encode():
                        edge[at] = False
                        end = at + len(c)
                        edge[end - 1] |= kind[end] == LETTER
        edge &= (kind[1:] != BLANK) & (kind[:-1] != BLANK)
        spaced = np.insert(data, np.flatnonzero(edge) + 1, 32).tobytes().decode()
        ids = self.words.encode_to_numpy(spaced, disallowed_special=())
        stops = np.flatnonzero(ids == self.stop)
        return [ids[a:b] for a, b in zip(np.r_[0, stops + 1][: len(texts)].tolist(), stops.tolist(), strict=True)]

    def other(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[tuple[bool, str]]] = []
        for t in texts:
            if "<|" not in t and PLAIN.fullmatch(t):
                parts.append([(True, t)])
                continue
            words = re.split("[\t-\r ]", t)
            parts.append([(ok, " ".join(g)) for ok, g in itertools.groupby(words, lambda w: "<|" not in w and PLAIN.fullmatch(w) is not None)])
        plain = iter(self.plain([s for p in parts for ok, s in p if ok]))
        found = [[next(plain) if ok else self.other(s) for ok, s in p] for p in parts]
        return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def in_groups(items: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive items, about size characters together."""
    group: list[str] = []
    n = 0
    for x in items:
        group.append(x)
        n += len(x)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids: each document's ids and end_id, cut at every multiple of window."""
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids
    schema = common.arrow_schema(ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            encoded = (x for group in in_groups(common.texts(batch.column(1)), GROUP_CHARS) for x in enc.encode_all(group))
            for key, got in zip(batch.column(0).to_pylist(), encoded, strict=True):
                got = np.append(got, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(got), window):
                    piece = got[a : a + window]
                    row = (key, a, len(piece), zlib.crc32(piece.tobytes()), len(got)) + ((piece.tolist(),) if ids else ())
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            yield common.batches(out, schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(common.bounded(run), ddl)


def combinations(bins: int, depth: int = DEPTH, held: np.ndarray | None = None) -> np.ndarray:
    """Shallow fillings of a window, as rows of counts by length: all multisets of at most ``depth`` lengths with sum bins, and all repeats of
    one or two lengths with that sum, so that a window of short pieces has fillings too. ``held``: whether a length occurs."""
    there = [i for i in range(1, bins + 1) if held is None or held[i - 1]]
    known = set(there)
    found: set[tuple[tuple[int, int], ...]] = set()
    for k in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(there, k - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1) and last in known:
                found.add(tuple(sorted((x, (*head, last).count(x)) for x in {*head, last})))
    for i in there:
        for n in range(1, bins // i + 1):
            rest = bins - n * i
            if not rest:
                found.add(((i, n),))
            found.update(tuple(sorted(((i, n), (j, rest // j)))) for j in range(i + 1, rest + 1) if j in known and rest % j == 0)
    out = np.zeros((len(found), bins), np.float64)
    for row, c in zip(out, sorted(found), strict=True):
        for x, n in c:
            row[x - 1] = n
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| for x >= 0, by an active set: the column with the steepest descent joins, negative ones leave."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = np.argsort(slope)[-8:]
        best = best[slope[best] > 1e-7 * (1 + np.abs(b).max())]
        if not len(best):
            break
        free[best] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 1e-9).all():
                break
            out = free & (z <= 1e-9)
            shrink = x[out] / np.maximum(x[out] - z[out], 1e-12)
            x += max(0.0, min(1.0, shrink.min())) * (z - x)
            gone = out & (x <= 1e-9)
            if not gone.any():
                gone = out
            free &= ~gone
            x[~free] = 0
        x = z
    return x


def solved(left: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often to use each, by the solver's rounded counts as far as the pieces last; takes what it uses off ``left``."""
    a = combinations(len(left), depth, left > 0)
    if not len(a):
        return []
    weight = np.sqrt(np.arange(1, len(left) + 1))  # padding costs by length
    x = np.rint(nnls((a * weight).T, left * weight)).astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-x, kind="stable"):
        need = a[i].astype(np.int64)
        n = min(int(x[i]), *(int(left[j] // need[j]) for j in np.flatnonzero(need)))
        if n > 0:
            left -= n * need
            out.append((tuple(int(j) + 1 for j in np.flatnonzero(need) for _ in range(need[j])), n))
    return out


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """How often to fill a window with which lengths (in steps), so that every length's count is used up exactly.

    The solver's counts are rounded and end where pieces run out; the rest is packed greedily, largest first, each time repeating
    one filling as often as the counts last, so work follows the number of different lengths and not of pieces.
    """
    bins, left = len(histogram), histogram.astype(np.int64).copy()
    out = solved(left, depth) if left.any() else []
    while left.any():
        room, fill = bins, []
        counts = left.copy()
        while room and (there := np.flatnonzero(counts[:room])).size:
            j = int(there[-1])
            k = min(int(counts[j]), room // (j + 1))
            fill += [j + 1] * k
            counts[j] -= k
            room -= k * (j + 1)
        need = np.bincount(np.array(fill) - 1, minlength=bins)
        n = int(min(left[j] // need[j] for j in np.flatnonzero(need)))
        left -= n * need
        out.append((tuple(sorted(fill, reverse=True)), n))
    return out


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, step: int = STEP, depth: int = DEPTH, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Documents are cut at multiples of window only. Whole pieces are sequences of their own. Short pieces of one length are bundled, and a bundle
    counts as a piece. The histogram of pieces and bundles, by length in steps (window / step numbers), goes to the driver, where
    counts of length combinations are solved by NNLS. A piece's rank among those of its length says which sequence takes it, so no group meets
    in one task: ranks come from counts by length and salt, and a length has as many salts as its count asks for. Returns ``pieces`` with sequence_id and offset.

    Null text is empty: such a document is its end id alone. Bytes that are not UTF-8 read as U+FFFD. Rows with a null or repeated id are packed like
    any other. An empty table gives an empty result. ``window`` is a multiple of ``step``. Extra columns are not read.
    """
    spark = docs.sparkSession
    short, bundle = min(SHORT, window // 4), min(BUNDLE, window)
    cut = common.table(pieces(docs, tokenizer, window=window, end_id=end_id, ids=ids, id_col=id_col, text_col=text_col), "pieces")
    # A kind of piece: its exact length, or behind those its length in steps.
    cut = cut.withColumn("kind", F.when(F.col("length") <= short, F.col("length")).otherwise(short + F.ceil(F.col("length") / step)).cast("int"))
    count = {r["kind"]: r["n"] for r in cut.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most short + window / step rows
    bins = window // step
    histogram = np.zeros(bins, np.int64)
    # kind, salts, pieces a unit, length in steps and first rank of full units, number of full units, length and rank of the last, not full one.
    units = []
    for kind, n in sorted(count.items()):
        each = bundle // kind if kind <= short else 1
        full, b = n // each, -(-each * kind // step) if kind <= short else kind - short
        last, c = n % each, max(1, -(-(n % each) * kind // step))
        ahead = int(histogram[b - 1])
        histogram[b - 1] += full
        units.append((kind, -(-n // RANKED), each, b, ahead, full, c, int(histogram[c - 1])))
        histogram[c - 1] += last > 0
    whole = int(histogram[bins - 1])
    rest = histogram.copy()
    rest[bins - 1] = 0
    # For each length, units of ranks from first on go to sequences from base on, per sequence `each` units at places from `place` on.
    runs, used, base = [(bins, 0, whole, 0, 1, 0)], np.zeros(bins, np.int64), whole
    for fill, n in plan(rest, depth) if rest.any() else []:
        place = 0
        for b in dict.fromkeys(fill):
            each = fill.count(b)
            runs.append((b, int(used[b - 1]), int(used[b - 1]) + n * each, base, each, place))
            used[b - 1] += n * each
            place += each
        base += n
    # Both tables are bounded by short and window / step: one has a row a kind, the other a row a length of a combination.
    unit = spark.createDataFrame(units or [(0,) * 8], "kind int, salts int, each long, full_bin int, full_from long, full long, last_bin int, last_from long")
    run = spark.createDataFrame(runs, "r_bin int, r_from long, r_to long, r_base long, r_each long, r_place long")
    cut = cut.join(F.broadcast(unit), "kind").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")).cast("int"))
    counts = cut.groupBy("kind", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("kind", "salt", (F.sum("n").over(Window.partitionBy("kind").orderBy("salt")) - F.col("n")).alias("ahead"))
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32"))).join(ahead, ["kind", "salt"])
    ranked = ranked.withColumn("nth", F.col("ahead") + F.col("nth") - 1).withColumn("bundle", F.floor(F.col("nth") / F.col("each"))).withColumn("within", F.col("nth") % F.col("each"))
    is_full = F.col("bundle") < F.col("full")
    ranked = ranked.withColumn("bin", F.when(is_full, F.col("full_bin")).otherwise(F.col("last_bin"))).withColumn("rank", F.when(is_full, F.col("full_from") + F.col("bundle")).otherwise(F.col("last_from")))
    placed = ranked.join(F.broadcast(run), (F.col("bin") == F.col("r_bin")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")))
    nth = F.col("rank") - F.col("r_from")
    placed = placed.withColumn("sequence_id", F.col("r_base") + F.floor(nth / F.col("r_each"))).withColumn("place", F.col("r_place") + nth % F.col("r_each"))
    seq = Window.partitionBy("sequence_id").orderBy("place", "within").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(seq), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, "sequence_id", offset)
