"""Profiling and routing of documents from their pages' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def page_profile(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, chars (visible), fffd, digital of each page. A null text is an empty page."""
    t = F.coalesce("text", F.lit(""))
    return pages.select("doc_id", "page_index", X.visible_chars(t).alias("chars"), X.replacement_chars(t).alias("fffd")).withColumn("digital", F.col("chars") >= S.DIGITAL_MIN_CHARS)


def document_profile(profile: DataFrame) -> DataFrame:
    """One row a document: total, digital_pages, raster_pages, fffd, chars, all_raster_empty. Partial sums are made before the shuffle."""
    long = lambda c: c.cast("long")
    out = profile.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("digital").alias("digital_pages"), long(F.sum("fffd")).alias("fffd"), long(F.sum("chars")).alias("chars"), F.every(F.col("digital") | (F.col("chars") < S.DIGITAL_MIN_CHARS)).alias("all_raster_empty")
    )
    return out.withColumn("raster_pages", F.col("total") - F.col("digital_pages"))


def profile_struct(profile: DataFrame) -> DataFrame:
    """doc_id and pages, an array of page structs in order; for documents whose pages fit a row."""
    return profile.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "chars", "fffd", "digital"))).alias("pages"))


def markdown_route() -> Column:
    """docling for documents with pages of which nine tenths are digital, else vl."""
    return F.when((F.col("total") > 0) & (F.col("digital_pages") / F.when(F.col("total") > 0, F.col("total")) >= S.DIGITAL_RATIO), "docling").otherwise("vl")


def already_searchable() -> Column:
    garbled = F.coalesce(F.col("fffd") / F.when(F.col("chars") > 0, F.col("chars")) > S.MOJIBAKE_RATIO, F.lit(False))
    return (F.col("total") > 0) & (F.col("raster_pages") == 0) & ~garbled


def family(route: Column) -> Column:
    """The model family of a job (mode, engine, upload_path) whose document has this markdown route (null: the probe failed); null where a pinned engine can't take it."""
    engine = F.coalesce("engine", F.lit("auto"))
    auto = F.when(F.col("upload_path").isNull(), "vl").otherwise(F.coalesce(route, F.lit("vl")))
    pinned = F.when(F.col("upload_path").isNotNull() & (route == "docling"), "docling")
    markdown = F.when(engine == "vl", "vl").when(engine == "docling", pinned).otherwise(auto)
    return F.when(F.col("mode") == "pdf", "ppocr").when(F.col("mode") == "markdown", markdown).otherwise("vl")


def family_error(route: Column) -> Column:
    return F.when(family(route).isNull(), "docling_ineligible")


def co_produce(sibling_engine: Column, route: Column) -> Column:
    """Whether a word pass should make its markdown sibling too."""
    engine = F.coalesce(sibling_engine, F.lit("auto"))
    return F.when(engine == "vl", True).when(engine == "docling", False).otherwise(F.coalesce(route == "vl", F.lit(False)))


def siblings(jobs: DataFrame) -> DataFrame:
    """Pairs of a word job and the markdown job of its group (no group never matches)."""
    word = jobs.where("mode = 'word'").select(F.col("id").alias("word_id"), "group_id", "upload_path")
    markdown = jobs.where("mode = 'markdown'").select(F.col("id").alias("markdown_id"), "group_id", "engine")
    return word.join(markdown, "group_id")


def zoom_for_area(zoom: Column, width: Column, height: Column, most: int) -> Column:
    """A page zoom lowered, to 0.4 at least, so that the raster has at most so many pixels."""
    area = width * zoom * height * zoom
    return F.when(area > most, F.greatest(F.lit(0.4), zoom * F.sqrt(most / area))).otherwise(zoom)


def zoom_for_edge(zoom: Column, width: Column, height: Column, longest: int = 4000) -> Column:
    edge = F.greatest(width, height)
    return F.least(zoom, F.lit(longest) / F.when(edge > 0, edge))
