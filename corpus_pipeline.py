"""A corpus from documents: reject, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
Filtering stages return each id once: rows without an id go, and of rows that repeat one the first by text stays. Null and empty
texts are documents like others. An empty table gives an empty result. Columns besides those of documents are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import common, decontaminate, jaccard, packing, quality, registry, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """The documents that a stage sees: those with an id; of rows that repeat one the first by text, nulls last."""
    return common.one_each(docs.select(*COLUMNS), "doc_id", order="text")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts get the base rates; without labels nothing is rejected."""
    rows = _rows(docs)
    verdicts = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), unique_ids=True)
    rejected = common.table(verdicts.where(~F.col("keep")).select("doc_id"), "rejected")
    return rows.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates. Documents without words are linked with nothing and stay."""
    rows = _rows(docs)
    found = jaccard.join(rows, unique_ids=True)
    gone = common.table(found.where("component_id <> doc_id").select("doc_id"), "gone")
    return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 100 that occur earlier; untouched ones as they were. Parts of characters that a cut leaves behind go, and so do documents of which nothing but white space is left."""
    docs = _rows(docs)
    kept = suffix.dedup(docs, unique_ids=True, whole=True).select("doc_id", "n_removed", F.col("kept").cast("string").alias("rest"))
    rows = docs.select("doc_id", F.col("text").isNull().alias("was_null"), "lang", "source", F.col("n_chars").alias("chars_before"))
    text = F.when(~F.col("was_null"), F.col("rest"))
    chars = F.when(F.col("n_removed") == 0, F.col("chars_before")).otherwise(F.length(text).cast("long"))
    out = kept.join(rows, "doc_id").select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"), "n_removed")
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*COLUMNS)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds the question and answer of a benchmark item. Null and empty texts stay; an empty benchmark leaves all."""
    rows = _rows(docs)
    found = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = common.table(found.where("leak").select("doc_id").distinct(), "leaks")
    return rows.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that hold them: of every row it gets, a null text as its end id alone."""
    return packing.pack(docs, registry.tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", classify), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("decontamination", decontaminate_docs), ("packing", pack)]

#: Stages score, compare and pack in ways that SQL can't state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written out and read again as the next one's input."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
