"""Outlines of documents from the look of their paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def looks_like_heading() -> Column:
    """Whether a paragraph with text (size, bold, alignment) is set like a heading."""
    return F.col("bold") & (F.col("size") >= S.HEADING_MIN_PT) & (F.coalesce("alignment", F.lit("")) != "justify")


def heading_levels(paragraphs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, level of the headings of documents in which they are at most half of the paragraphs with text.

    Sizes of a document's headings rank from the largest, the fourth and later being level 4. ``levels`` (doc_id, key, level), where given, goes
    before: the level of the heading with the same text but for white space. One aggregate by document gathers counts and headings, without their texts.
    """
    key = X.fingerprint(F.col("text")) if levels is not None else F.lit(None).cast("string")
    rows = paragraphs.where(X.strip(F.col("text")) != "").select("doc_id", "seq", "size", F.coalesce(looks_like_heading(), F.lit(False)).alias("heading"), key.alias("key"))
    held = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("heading"), F.struct("seq", "size", "key"))).alias("heads"))
    held = held.where((F.size("heads") > 0) & (F.size("heads") <= F.col("n") * S.HEADING_FRACTION))
    sizes = F.array_distinct(F.transform("heads", lambda h: h["size"]))
    out = held.select("doc_id", sizes.alias("sizes"), F.explode("heads").alias("h")).select("doc_id", "h.seq", "h.key", F.size(F.filter("sizes", lambda x: x >= F.col("h.size"))).alias("rank"))
    level = F.col("rank")
    if levels is not None:
        out = out.join(levels.select("doc_id", "key", F.col("level").alias("known")), ["doc_id", "key"], "left")
        level = F.coalesce("known", "rank")
    return out.select("doc_id", "seq", F.least(F.lit(S.HEADING_LEVELS), level).cast("int").alias("level"))


def known_levels(markdown: DataFrame) -> DataFrame:
    """doc_id, key, level: the first level of each heading text in Markdown (doc_id, text)."""
    heads = markdown.select("doc_id", F.posexplode(X.heading_lines(F.col("text"))).alias("pos", "h"))
    return heads.groupBy("doc_id", X.fingerprint(F.col("h.text")).alias("key")).agg(F.min_by("h.level", "pos").alias("level"))
