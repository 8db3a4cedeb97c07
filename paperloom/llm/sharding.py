"""Global shuffle into shards of equal row counts by a two-pass external shuffle (operator 9), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
SEED = 20_240_917
#: UTF-8 bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Buckets that one task shuffles, one after the other; buckets whose offsets are summed in one task.
TOGETHER, RANGE = 8, 4096


def buckets_for(total_bytes: int, rows: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-(total_bytes + 64 * rows) // bucket_bytes))


def shuffle_into_shards(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, bucket, position, shard and slot of all rows, in one uniformly random order that the seed fixes.

    Pass 1 scatters rows by a seeded hash over buckets that fit in memory. Pass 2 gathers a bucket, sorts it so that its order doesn't
    depend on arrival, and Fisher-Yates shuffles it (``shuffle`` with a seed from the bucket's number). Buckets follow each
    other, positions are dealt round: shard = position mod shards, so shard counts are at most one apart and slots are gapless.

    Null text is kept as null. Rows may repeat: equal rows are spread by their rank among equal ids, so a third of all rows with one id
    still fills all buckets evenly. A null id is an id like any other. An empty table gives an empty result; extra columns
    are not read. A text larger than a bucket makes that bucket as large as the text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    of = ids.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max("n").alias("most")).first()
    if (of["most"] or 0) > 1:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", F.pmod(F.xxhash64("text"), F.lit(64))).orderBy("text")))
    else:
        rows = rows.withColumn("copy", F.lit(1))
    n = buckets_for(of["bytes"] or 0, of["rows"] or 0, bucket_bytes)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), F.lit(n)).cast("int"))
    sizes = common.table(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    # Offsets are sums over ranges of buckets, of which the driver adds up one number each (for 100 TB some thousands), and within each range.
    span = F.floor(F.col("bucket") / RANGE).cast("int")
    before, ahead = [], 0
    for r in sizes.groupBy(span.alias("span")).agg(F.sum("n").alias("n")).orderBy("span").collect():
        before.append((r["span"], ahead))
        ahead += r["n"]
    starts = spark.createDataFrame(before, "span int, start long")
    sizes = sizes.withColumn("span", span).join(F.broadcast(starts), "span")
    sizes = sizes.select("bucket", (F.col("start") + F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n")).alias("ahead"))
    # The number of partitions follows from the data, and each is sorted: the generator behind shuffle() starts from its seed and the partition, so reruns give the same order.
    mixed = rows.repartition(-(-n // TOGETHER), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "copy", "text")).alias("held"))
    mixed = mixed.select("bucket", F.array_sort("held").alias("held")).sortWithinPartitions("bucket")
    mixed = mixed.select("bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    out = mixed.join(sizes, "bucket").select("bucket", "ahead", F.posexplode("held").alias("at", "row"))
    position = F.col("ahead") + F.col("at")
    return out.select("row.doc_id", "row.text", "bucket", position.alias("position")).select(
        "*", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, each file in slot order."""
    shuffled.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
