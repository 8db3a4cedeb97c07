"""Conversion requests: validation, file acceptance, fan-out to jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def modes(raw: Column) -> Column:
    """Different modes of a comma-separated list in order; null where the list has none or an unknown one."""
    items = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), X.strip), lambda x: x != "")
    good = (F.size(items) > 0) & F.forall(items, lambda x: x.isin(*S.MODES))
    return F.when(good, F.array_distinct(items))


def validate(requests: DataFrame) -> DataFrame:
    """requests (modes, locale, engine, ...) with mode_list, locale, engine and the first error, if any."""
    engine = F.coalesce("engine", F.lit("auto"))
    out = requests.withColumns({"mode_list": modes(F.col("modes")), "locale": X.strict_locale(F.col("locale")), "engine": engine})
    error = F.when(F.col("mode_list").isNull(), "invalid_modes").when(~F.col("engine").isin(*S.ENGINES), "invalid_engine")
    return out.withColumn("problem", error.when((F.col("engine") != "auto") & ~F.array_contains("mode_list", "markdown"), "engine_requires_markdown_mode"))


def preflight(content: Column, size: Column | None = None, most: int = S.PARSED_BYTES) -> Column:
    """not_pdf, encrypted_pdf, invalid_pdf or empty_pdf, null for a file that may be converted.

    The first five bytes come first: a file without the mark is not a PDF, an empty one neither. A file of over ``most`` bytes is taken
    unless the last 64 KiB name an encryption dictionary. A smaller one is looked at as a whole: without a catalogue it is invalid, and it is empty where
    its page trees, all in plain objects, count no page. A file that can't be read (null) is invalid.
    """
    size = F.length(content) if size is None else size
    latin = lambda x: F.decode(x, "ISO-8859-1")
    encrypted = r"/Encrypt\s*(?:<<|\d+\s+\d+\s+R)"
    head, tail, whole = latin(F.substring(content, 1, 5)), latin(F.substring(content, F.greatest(F.lit(1), F.length(content) - S.TAIL_BYTES + 1), F.lit(S.TAIL_BYTES))), latin(content)
    plain_tree = whole.rlike(r"/Type\s*/Pages\b") & ~whole.rlike(r"/Type\s*/ObjStm\b")
    reason = F.when(content.isNull(), "invalid_pdf").when(head != "%PDF-", "not_pdf")
    reason = reason.when(size > most, F.when(tail.rlike(encrypted), "encrypted_pdf"))
    return reason.when(whole.rlike(encrypted), "encrypted_pdf").when(~whole.rlike(r"/Root\s*\d+\s+\d+\s+R"), "invalid_pdf").when(plain_tree & ~whole.rlike(r"/Type\s*/Page\b"), "empty_pdf")


def skip_reason() -> Column:
    """Why a file (filename, truncated, reason of its preflight) is skipped; null where it is taken."""
    return F.when(F.col("truncated"), "too_large").when(~F.lower("filename").endswith(".pdf"), "unsupported").otherwise(F.col("reason"))


def split_accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = files.withColumn("skipped", skip_reason())
    return files.where("skipped is null").drop("skipped"), files.where("skipped is not null")


def unique_files(files: DataFrame) -> DataFrame:
    """The first (by seq) of files with the same name, size and time, of those that are PDFs by name or type."""
    pdf = F.lower("name").endswith(".pdf") | (F.col("mime") == "application/pdf")
    w = Window.partitionBy("name", "size", "last_modified").orderBy("seq")
    return files.where(pdf).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fan_out(files: DataFrame) -> DataFrame:
    """A job for each file and mode. Markdown and word of one file share a group; only markdown keeps the engine. Ids follow from file and mode."""
    dual = F.array_contains("mode_list", "markdown") & F.array_contains("mode_list", "word")
    rows = files.select("*", F.explode("mode_list").alias("mode"))
    group = F.when(dual & (F.col("mode") != "pdf"), F.concat(F.lit("g"), F.col("file_id").cast("string")))
    return rows.select(F.concat_ws("-", F.col("file_id").cast("string"), "mode").alias("id"), group.alias("group_id"), "mode", "filename", "locale", F.when(F.col("mode") == "markdown", F.col("engine")).otherwise("auto").alias("engine"), F.lit("queued").alias("status"))


def zip_budget(files: DataFrame, cap: int = S.ZIP_CAP, upload_cap: int | None = None) -> DataFrame:
    """Files (folder, name, size) but .docx in name order with the running total of their folder, and whether that is over the cap, or over that of uploads if it is less."""
    most = cap if upload_cap is None else min(cap, upload_cap)
    w = Window.partitionBy("folder").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    return files.where(~F.lower("name").endswith(".docx")).select("folder", "name", "size", F.sum("size").over(w).alias("running")).withColumn("too_large", F.col("running") > most)


def archived_name(name: Column, download_id: Column, original: Column) -> Column:
    """The name of a file in its archive: under a folder named after the original, where the main Markdown has the original's name too."""
    base = X.download_name(X.stem(original))
    return F.concat(base, F.lit("-markdown/"), F.when(name == F.concat(download_id, F.lit(".md")), F.concat(base, F.lit(".md"))).otherwise(name))


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*S.IMAGE_SUFFIXES)


def images(files: DataFrame) -> DataFrame:
    return files.where(is_image(F.col("name")))


def image_counts(files: DataFrame) -> DataFrame:
    """folder and its number of image files."""
    return files.groupBy("folder").agg(F.count_if(is_image(F.col("name"))).alias("images"))


def merged_markdown(parts: DataFrame) -> DataFrame:
    """folder and text: the folder's parts (name, text) in name order, a blank line between."""
    held = parts.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("p"))
    return held.select("folder", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def gpu_row(line: Column) -> Column:
    """name, total and used megabytes of a comma-separated status line."""
    parts = F.transform(F.split(F.split(line, "\n")[0], ","), X.strip)
    return F.struct(parts[0].alias("name"), F.get(parts, F.lit(1)).try_cast("int").alias("vram_total_mb"), F.get(parts, F.lit(2)).try_cast("int").alias("vram_used_mb"))


def searchable_result(pages: Column, name: Column) -> Column:
    """The result of a file that is passed through because it can be searched already."""
    return F.struct(pages.alias("totalPages"), name.alias("originalName"), F.lit("none").alias("engine"), F.lit("already_searchable").alias("notice"))
