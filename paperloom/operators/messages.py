"""Messages by key and locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def localized(rows: DataFrame, messages: DataFrame, default: str = "zh-TW", **values: Column) -> DataFrame:
    """rows (key, locale, ...) with message: the template (key, locale, template) of the normalised locale, else of the default one, else the key itself, its places filled.

    The catalogue is spread by key to an array of its locales, so one join serves both look-ups; Spark broadcasts it where its size allows.
    """
    by_key = messages.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("locale", "template"))).alias("_by"))
    out = rows.join(by_key, "key", "left")
    template = F.coalesce(F.try_element_at("_by", X.normal_locale(F.col("locale"))), F.try_element_at("_by", F.lit(default)), F.col("key"))
    return out.withColumn("message", X.fill(template, **values)).drop("_by")
