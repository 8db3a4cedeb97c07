"""Benchmark decontamination by BM25 and block-max WAND (operator 6)."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: A passage is fetched for an item when its score is this part of the item's own.
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
#: Least items of a block that shares upper bounds, most blocks of an index.
BLOCK, BLOCKS = 8, 64
#: Items in one index, and indexes that a pass over the documents holds: what a broadcast holds at most.
ITEMS, INDEXES = 2_000, 16
#: Words whose passages are searched together.
WORDS = 1 << 16
#: Marks beyond ASCII, which part words as ASCII marks and blanks do.
MARKS = re.compile("[\xa0-\xbf\u1680\u2000-\u206f\u3000-\u303f]+")
FOLD = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def split_words(text: str) -> list[bytes]:
    """Words in lower case: runs of letters and digits, as UTF-8."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode().translate(FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words in two: the last sentence of several is the answer; of a single sentence the last fifth of its words."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := split_words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 5) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


class Statistics:
    """What scores take from a whole benchmark: its number of items, their mean and largest number of words, and in how many items each word is."""

    def __init__(self, n: int, mean: float, longest: int, frequency: dict[bytes, int]) -> None:
        self.n, self.mean, self.longest, self.frequency = n, mean, longest, frequency

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for t in texts if (w := split_words(t))]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), Counter(w for item in words for w in set(item)))


class Index:
    """An inverted index of items with impacts as parts of the item's own score. Items of like lengths are in blocks; a term has its largest
    impact in each block, its largest of all, and for every block the next one that holds it."""

    def __init__(self, ids: list[int], texts: list[str], statistics: Statistics | None = None, block: int = BLOCK) -> None:
        words = [split_words(t) for t in texts]
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: (len(words[i]), ids[i]))
        known = statistics or Statistics.of(texts)
        self.ids = [ids[i] for i in order]
        self.words = [words[i] for i in order]
        self.parts = [question_and_answer(texts[i]) for i in order]
        self.half = max(32, known.longest)
        n = len(order)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        own = np.zeros(n)
        for i, w in enumerate(self.words):
            for t, tf in Counter(w).items():
                idf = math.log(1 + (known.n - known.frequency[t] + 0.5) / (known.frequency[t] + 0.5))
                x = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / known.mean))
                postings.setdefault(t, []).append((i, x))
                own[i] += x
        self.block = block = max(block, -(-n // BLOCKS))
        self.terms = {t: k for k, t in enumerate(sorted(postings))}
        rows = [(i // block, k, i, x / own[i]) for t, k in self.terms.items() for i, x in postings[t]]
        rows.sort()
        blocks, term, self.item, self.impact = (np.array([r[c] for r in rows], kind) for c, kind in enumerate((np.int64, np.int64, np.int64, np.float64)))
        self.blocks, self.unknown = -(-n // block), len(self.terms)
        #: By block and term: postings from first to last.
        self.first = np.searchsorted(blocks * self.unknown + term, np.arange(self.blocks * self.unknown + 1))
        self.bounds = np.zeros((self.unknown, self.blocks), np.float32)
        np.maximum.at(self.bounds, (term, blocks), (self.impact * (1 + 1e-6)).astype(np.float32))
        self.largest = self.bounds.max(axis=1, initial=0).astype(np.float64)
        #: The first block from a given one on that holds the term; that behind the last stands for none.
        self.next = np.full((self.unknown, self.blocks + 1), self.blocks, np.uint8)
        for b in range(self.blocks - 1, -1, -1):
            self.next[:, b] = np.where(self.bounds[:, b] > 0, b, self.next[:, b + 1])

    def scores(self, block: int, terms: np.ndarray) -> np.ndarray:
        """Scores of a block's items for different terms."""
        at = block * self.unknown + terms
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        rows = np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.item[rows] - block * self.block, self.impact[rows], minlength=self.block)

    def candidates(self, owner: np.ndarray, term: np.ndarray, n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passages (of n) and blocks that can reach the threshold, for passages' different terms: block-max WAND over all passages in step.

        A passage's cursors, one a term, stand at the next block that holds the term. With cursors in order of their blocks, the pivot is the block
        at which the terms' largest impacts of all first add up to the threshold: no block before it can reach it, so cursors skip
        there. The pivot's own largest impacts then say whether its items are scored. Cursors move past it, and a passage without pivot is done.
        """
        at = np.zeros(n, np.int64)
        number = np.arange(n)
        width = self.blocks + 1
        while len(number):
            cursor = self.next[term, at[owner]]
            reach = np.bincount(owner * width + cursor, self.largest[term], minlength=len(number) * width).reshape(-1, width)[:, :-1].cumsum(axis=1)
            there = reach >= threshold
            going = there[:, -1]
            pivot = there.argmax(axis=1)
            # Passages without a pivot leave; the others are numbered anew.
            place = np.cumsum(going) - 1
            keep = going[owner]
            owner, term = place[owner[keep]], term[keep]
            number, pivot = number[going], pivot[going]
            bound = np.bincount(owner, self.bounds[term, pivot[owner]], minlength=len(number))
            hit = bound >= threshold
            yield number[hit], pivot[hit]
            going = pivot + 1 < self.blocks
            place = np.cumsum(going) - 1
            keep = going[owner]
            owner, term = place[owner[keep]], term[keep]
            number, at = number[going], pivot[going] + 1

    def search(self, lists: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """Text, first word of the passage, item and score of every passage and item that reach the threshold.

        Passages are windows of two halves, half a window apart; a last one may be shorter, and a text of up to a half is one.
        """
        half, blocks = self.half, self.blocks
        if not blocks:
            return
        size = np.array([len(w) for w in lists], np.int64)
        starts = np.cumsum(size) - size
        known = np.fromiter(map(self.terms.get, itertools.chain.from_iterable(lists), itertools.repeat(-1)), np.int64, int(size.sum()))
        # Passages of each text, numbered through; the half that a word is in belongs to the passage it opens and to the one before.
        passages = np.maximum(1, -(-size // half) - 1) * (size > 0)
        first = np.cumsum(passages) - passages
        text = np.repeat(np.arange(len(lists)), size)
        place = (np.arange(len(known)) - starts[text]) // half
        here = np.flatnonzero(known >= 0)
        opens, follows = here[place[here] < passages[text[here]]], here[place[here] > 0]
        owner = np.concatenate([first[text[opens]] + place[opens], first[text[follows]] + place[follows] - 1])
        pairs = np.unique(owner * self.unknown + known[np.concatenate([opens, follows])])
        owner, term = pairs // self.unknown, pairs % self.unknown
        ends = np.searchsorted(owner, np.arange(int(passages.sum()) + 1))
        of = np.repeat(np.arange(len(lists)), passages)
        for hits, at in self.candidates(owner, term, int(passages.sum()), threshold):
            for p, b in zip(hits.tolist(), at.tolist(), strict=True):
                found = self.scores(b, term[ends[p] : ends[p + 1]])
                for i in np.flatnonzero(found >= threshold).tolist():
                    yield int(of[p]), (p - int(first[of[p]])) * half, b * self.block + i, float(found[i])

    def overlap(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Parts of the question's and of the answer's word shingles that the words hold; 1 for a part without words."""
        out = []
        for part in self.parts[item]:
            have = shingles(part)
            size = min(SHINGLE, len(part))
            there = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if part else set()
            out.append(len(have & there) / len(have) if have else 1.0)
        return out[0], out[1]

    def leaks(self, lists: list[list[bytes]], threshold: float = THRESHOLD) -> list[list[tuple[int, int, float, float, float]]]:
        """For each text (its words) item, first word of the passage, score, question's and answer's overlap: for each item the best of the text's passages.

        Passages are windows of twice the longest item's words, half a window apart, so an item's copy lies whole in one.
        """
        best: list[dict[int, tuple[int, int, float, float, float]]] = [{} for _ in lists]
        for t, a, item, score in self.search(lists, threshold):
            q, r = self.overlap(item, lists[t][a : a + 2 * self.half])
            row, old = (self.ids[item], a, score, q, r), best[t].get(item)
            if old is None or (min(q, r), score, -a) > (min(old[3:]), old[2], -old[1]):
                best[t][item] = row
        return [[b[i] for i in sorted(b)] for b in best]


def in_portions(texts: Iterable[str], size: int = WORDS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of consecutive texts, about size words together, and the number of the first text."""
    held: list[list[bytes]] = []
    n = k = 0
    for k, text in enumerate(texts, 1):
        held.append(split_words(text))
        n += len(held[-1])
        if n >= size:
            yield k - len(held), held
            held, n = [], 0
    if held:
        yield k - len(held), held


POSTINGS = "id long, word binary, length long"


def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = common.arrow_schema(POSTINGS)
    for batch in it:
        rows = [(i, w, len(words)) for i, t in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)), strict=True) for words in [split_words(t)] for w in set(words)]
        yield common.batches({"id": [r[0] for r in rows], "word": [r[1] for r in rows], "length": [r[2] for r in rows]}, schema)


def indexes(benchmark: DataFrame, items: int) -> Iterator[Index]:
    """Indexes of at most ``items`` items each, under the statistics of the whole benchmark. The driver holds one index's items and words at a time."""
    postings = common.table(benchmark.mapInArrow(common.bounded(post), POSTINGS), "postings")
    lengths = postings.groupBy("id").agg(F.first("length").alias("length"))
    of = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    # Items in order of their lengths, two numbers each, are one task's: a benchmark is a set of tests and not a corpus.
    part = F.floor((F.row_number().over(Window.orderBy("length", "id")) - 1) / items).cast("int")
    parts = common.table(lengths.select("id", part.alias("part")), "parts")
    frequency = common.table(postings.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequency")
    for k in range(-(-of["n"] // items)):
        mine = parts.where(F.col("part") == k).select("id")
        got = benchmark.join(mine, "id").select("id", "t").orderBy("id").toArrow()
        words = frequency.join(postings.join(mine, "id", "left_semi").select("word").distinct(), "word").toArrow()
        yield Index(got["id"].to_pylist(), common.texts(got["t"].combine_chunks()), Statistics(of["n"], of["mean"], of["longest"], dict(zip(words["word"].to_pylist(), words["n"].to_pylist(), strict=True))))


FOUND = "doc_id long, item_id long, passage long, score double, question double, answer double, leak boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP, items: int = ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question, answer, leak: every pair of a document and an item with a passage over the BM25 threshold.

    Scores count a passage's different words and are parts of the item's own. A pair is a leak if the passage holds ``overlap`` or more of
    the five-word shingles of both the item's question and its answer.

    The benchmark is indexed in parts of at most ``items`` items, under statistics of the whole, so scores don't depend on the parts. A pass
    over the documents splits each once and searches as many parts as a broadcast may hold (INDEXES); nothing of the documents is shuffled.
    Bytes that are not UTF-8 read as U+FFFD. Null or wordless items and texts match nothing; rows with a null id are left out; repeated documents are searched each, of
    items that repeat an id the first by text stays. Empty tables give an empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    bench = common.one_each(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where(F.col("t").isNotNull()), "id", order="t")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    out = spark.createDataFrame([], FOUND)
    for held in itertools.batched(indexes(bench, items), INDEXES):
        shared = spark.sparkContext.broadcast(held)  # at most ITEMS * INDEXES items

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = common.arrow_schema(FOUND)
            for batch in it:
                found: list[tuple] = []
                keys = batch.column(0).to_pylist()
                for a, lists in in_portions(common.texts(batch.column(1))):
                    for index in shared.value:
                        for k, leaks in enumerate(index.leaks(lists, threshold), a):
                            found += [(keys[k], item, p, score, q, r, q >= overlap and r >= overlap) for item, p, score, q, r in leaks]
                yield common.batches({f.name: [x[c] for x in found] for c, f in enumerate(schema)}, schema)

        out = out.unionByName(rows.mapInArrow(common.bounded(run), FOUND))
    return out
