"""Quality classification by hierarchical empirical Bayes (operator 10)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, jaccard

#: Labelled documents on which the classifier is fitted, at most: it bounds what the driver and the executors hold of words and weights.
SAMPLE = 40_000
#: Labelled documents that a word needs.
SUPPORT = 5
#: Different words that a task counts before it sends the counts on.
HELD = 100_000
#: A longer word is told by the digest of all its bytes.
LONGEST = 48
#: Least evidence of a word: log odds over their standard error.
Z = 4.0
#: Reject at this probability of a fault.
REJECT = 0.5
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
UPPER = bytes(range(65, 91))


def step(x: float) -> int:
    """Parts of a text in steps that a few documents' noise doesn't cross: 0, up to 2, 4, 8, 16, 32, 64 and 100 per cent."""
    return 0 if x <= 0.01 else min(7, 1 + max(0, math.ceil(math.log2(max(x, 1e-9) / 0.02))))


def words_of(text: bytes) -> list[bytes]:
    """Words of letters only, A-Z folded; long ones by their digest."""
    words = text.translate(FOLD).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w if len(w) <= LONGEST else b"#" + hashlib.blake2b(w, digest_size=16).digest() for w in words]


def shape(text: bytes, words: list[bytes]) -> list[int]:
    """The text's shape as places in a vector of SHAPES: parts of capitals, of repeated neighbours, of marks and of each mark, by steps. Few words have no shape."""
    n = len(text)
    if len(words) <= 4:
        return []
    parts = [(n - len(text.translate(None, UPPER))) / n, sum(map(bytes.__eq__, words, words[1:])) / len(words), (n - len(text.translate(None, MARKS))) / n]
    return [8 * k + step(x) for k, x in enumerate([*parts, *(text.count(m) / n for m in MARKS)])]


SHAPES = 8 * (3 + len(MARKS))


COUNTS = "feature binary, n long, n_low long, n_toxic long"


def count_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = common.arrow_schema(COUNTS)
    held: dict[bytes, list[int]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        for b in range(0, len(items), 1 << 16):
            part = items[b : b + (1 << 16)]
            yield common.batches({"feature": [k for k, _ in part], "n": [v[0] for _, v in part], "n_low": [v[1] for _, v in part], "n_toxic": [v[2] for _, v in part]}, schema)

    for batch in it:
        for text, low, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for f in set(words_of(text or b"")):
                row = held.setdefault(f, [0, 0, 0])
                row[0] += 1
                row[1] += low
                row[2] += toxic
            if len(held) > HELD:
                yield from send()
                held.clear()
    yield from send()


KEYS = "doc_id long, key long"


def least_shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys = [int(s[0]) >> 1 if len(s) else -1 for s in jaccard.shingle_sets(jaccard.raw(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64())], schema=common.arrow_schema(KEYS))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


class Model:
    """Log odds of the two faults, low quality and toxic: a linear function of a document's shape and of the evidence of its words."""

    def __init__(self, words: dict[bytes, tuple[float, float]], weights: np.ndarray) -> None:
        self.words, self.weights = words, weights

    def evidence(self, text: bytes) -> tuple[float, float, list[int]]:
        """Summed weights of the document's different words for each fault, and its shape."""
        words = words_of(text)
        hits = [self.words[w] for w in self.words.keys() & set(words)]
        return sum(h[0] for h in hits), sum(h[1] for h in hits), shape(text, words)

    def score(self, text: bytes) -> tuple[float, float]:
        low, toxic, bins = self.evidence(text)
        x = self.weights[:, :5] @ word_terms(low, toxic) + self.weights[:, [5 + b for b in bins]].sum(axis=1)
        return float(np.clip(x[0], -30, 30)), float(np.clip(x[1], -30, 30))


def word_terms(low: float, toxic: float) -> np.ndarray:
    return np.array([1.0, min(low, 20) / 5, low > 0, min(toxic, 20) / 5, toxic > 0])


def logistic(terms: np.ndarray, bins: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method on terms and, behind them, 0/1 columns; the first column, a constant, is not held back."""
    n, k = len(y), terms.shape[1] + bins.shape[1]
    w, hold = np.zeros(k), np.full(k, ridge)
    hold[0] = 1e-6
    for _ in range(25):
        slope, curve = -hold * w, np.diag(hold)
        for a in range(0, n, 4096):  # a part at a time, so that only small columns are held for all rows
            x = np.concatenate([terms[a : a + 4096], bins[a : a + 4096]], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (y[a : a + 4096] - p)
            curve += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        step_ = np.linalg.solve(curve, slope)
        w += step_
        if np.abs(step_).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, support: int = SUPPORT, z: float = Z, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents, those with the smallest hashes of their ids, chosen among all.

    Of copies and near copies among them one stays. Words are weighed by grouped counts: a log odds ratio r with variance v has weight r * max(0, 1 - v / r^2), where it stands z errors or more
    above 0. Every such word of the sample comes to the driver. How their sums and the text's shape go together is fitted on the same documents.
    The chosen ids meet the documents by broadcast, so no text is shuffled.
    """
    hashed, n = labels.withColumn("h", F.xxhash64("doc_id")), labels.count()
    if n > 2 * sample:  # a bound that holds half as many again, so that the sort need not see all labels
        hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * (1.5 * sample / n)))
    chosen = hashed.orderBy("h", "doc_id").limit(sample).drop("h")
    marked = common.table(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "low", "toxic"), "marked")
    # Copies are no evidence of their own: of documents with the same least shingle, as copies and most near copies have, one counts.
    heads = marked.select("doc_id", "text").mapInArrow(common.bounded(least_shingles), KEYS).groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    marked = common.table(marked.join(F.broadcast(heads), "doc_id", "left_semi").select("text", "low", "toxic"), "heads")
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    n = totals["n"] or 0
    if not n:
        weights = np.zeros((2, 5 + SHAPES))
        weights[:, 0] = -30
        return Model({}, weights)
    counts = common.table(marked.mapInArrow(common.bounded(count_features), COUNTS).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "n_low", "n_toxic"))).where(F.col("n") >= support), "features")
    words: dict[bytes, list[float]] = {}
    for k, (column, bad) in enumerate((("n_low", totals["low"]), ("n_toxic", totals["toxic"]))):
        a, b = F.col(column) + 0.5, F.col("n") - F.col(column) + 0.5
        c, d = F.lit(bad) - F.col(column) + 0.5, F.lit(n - bad) - (F.col("n") - F.col(column)) + 0.5
        ratio, var = F.log(a * d / (b * c)), 1 / a + 1 / b + 1 / c + 1 / d
        for row in counts.select("feature", ratio.alias("r"), var.alias("v")).where(F.col("r") >= z * F.sqrt("v")).collect():  # bounded by the sample's words
            words.setdefault(bytes(row["feature"]), [0.0, 0.0])[k] = row["r"] * max(0.0, 1 - row["v"] / row["r"] ** 2)
    model = Model({w: (x[0], x[1]) for w, x in words.items()}, np.zeros((2, 5 + SHAPES)))
    ddl = "low int, toxic int, by_words double, by_toxic_words double, bins array<int>"

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [model.evidence(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield common.batches({"low": batch.column(1).to_pylist(), "toxic": batch.column(2).to_pylist(), "by_words": [r[0] for r in rows], "by_toxic_words": [r[1] for r in rows], "bins": [r[2] for r in rows]}, common.arrow_schema(ddl))

    got = marked.mapInArrow(common.bounded(vectors), ddl).toArrow()  # at most `sample` rows
    terms = np.array([word_terms(a, b) for a, b in zip(got["by_words"].to_pylist(), got["by_toxic_words"].to_pylist(), strict=True)])
    bins = np.zeros((len(terms), SHAPES), np.uint8)
    for row, places in zip(bins, got["bins"].to_pylist(), strict=True):
        row[places] = 1
    for k, name in enumerate(("low", "toxic")):
        model.weights[k] = logistic(terms, bins, got[name].to_numpy().astype(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, *, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", model: Model | None = None, unique_ids: bool = False) -> DataFrame:
    """doc_id, p_low, p_toxic, host_rate, path_rate, p_fault, keep for each document.

    The classifier's evidence for a document (``fit`` on the labelled ones) gives a probability of a fault. These are summed by
    path (host and path) and by host over all documents; a host's rate is drawn toward the global one, and a path's toward its host's, by
    the weight that the spread between sites supports (method of moments). A document's log odds move by those of its path, without
    its own share, over the global ones.

    labels: doc_id, quality (0 is low), toxic (1 is toxic); null labels count as no fault, of repeated ids the worst label counts. Without labels nothing is
    rejected. Null text is empty and gets the base rates; a null host or path is a site of its own. Rows without an id are left out; of rows
    that repeat an id the one with the smallest text (null last) stays. Extra columns are not read.
    """
    spark = docs.sparkSession
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    columns += [F.col(c).cast("string").alias(a) if c in docs.columns else F.lit(None).cast("string").alias(a) for c, a in ((host, "host"), (path, "path"))]
    rows = common.one_each(docs.select(*columns), "doc_id", order="text", unique=unique_ids)
    if model is None:
        marks = labels.select(F.col("doc_id").cast("long"), F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)).alias("low"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"))
        model = fit(rows.select("doc_id", "text"), marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")))
    held = spark.sparkContext.broadcast(model)  # words of at most SAMPLE documents
    ddl = "doc_id long, host string, path string, low double, tox double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(ddl)
        for batch in it:
            scores = [held.value.score(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.string()), batch.column(3).cast(pa.string()), pa.array([s[0] for s in scores], pa.float64()), pa.array([s[1] for s in scores], pa.float64())], schema=schema)

    scored = common.table(rows.mapInArrow(common.bounded(run), ddl), "scores")
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    scored = scored.withColumn("p_low", p("low")).withColumn("p_toxic", p("tox")).withColumn("p", F.lit(1) - (1 - F.col("p_low")) * (1 - F.col("p_toxic")))
    site = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    scored = scored.withColumn("h", F.struct(F.col("host").isNull(), site[0])).withColumn("hp", F.struct(F.col("path").isNull(), site[1]))
    paths = scored.groupBy("h", "hp").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("bad"))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("sites")).first()
    total, rate = every["n"] or 0, min(1 - 1e-4, max(1e-4, (every["bad"] or 0) / max(1, every["n"] or 0)))

    def weight(sites: DataFrame, around: Column) -> float:
        """Documents that the prior counts for: rate (1 - rate) / spread between sites - 1, where the spread exceeds chance; between 10 and 10,000."""
        x = F.col("bad") / F.col("n") - around
        got = sites.agg(F.sum(F.col("n") * x * x).alias("ss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
        spread = ((got["ss"] or 0) - rate * (1 - rate) * (got["k"] or 0)) / max(1, got["n"] or 0)
        return float(np.clip(rate * (1 - rate) / spread - 1 if spread > 0 else 10_000, 10, 10_000))

    k_host = weight(hosts, F.lit(rate)) if total else 10.0
    hosts = hosts.select("h", ((F.col("bad") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, "h")
    k_path = weight(paths, F.col("host_rate")) if total else 10.0
    # Written out, so that both sides of the join are dealt for it alone and a site with many documents can be split.
    paths = common.table(paths.select("h", "hp", "n", "bad", "host_rate"), "paths")
    out = scored.join(paths, ["h", "hp"])
    others = (F.col("bad") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = out.withColumn("path_rate", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), others)))
    shift = logit(F.col("path_rate")) - F.lit(math.log(rate / (1 - rate)))
    fault = F.greatest(1 / (1 + F.exp(-(F.col("low") + shift))), 1 / (1 + F.exp(-(F.col("tox") + shift))))
    return out.withColumn("p_fault", fault).select("doc_id", "p_low", "p_toxic", "host_rate", "path_rate", "p_fault", (F.col("p_fault") < reject).alias("keep"))


def accuracy(result: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by what their label says and by what the classifier decided."""
    fault = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return result.join(labels, "doc_id").groupBy(fault.alias("fault"), "keep").count()
