"""The model's tables, read from or derived from the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of a time without zone, whatever the session's zone.
EPOCH = "cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6)) as double)"

JOBS = """
cast(event_id as string) as id,
case when event_id % 5 = 0 then null else concat('g', cast(event_id - event_id % 2 as string)) end as group_id,
case event_id % 3 when 0 then 'pdf' when 1 then 'markdown' else 'word' end as mode,
concat('file', cast(event_id as string), '.pdf') as filename,
case user_id % 3 when 0 then 'zh-TW' when 1 then 'zh-CN' else 'en' end as locale,
case when event_id % 3 <> 1 then 'auto' when user_id % 4 = 0 then 'docling' when user_id % 4 = 1 then 'vl' else 'auto' end as engine,
case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'purchase' then 'done' when 'error' then 'error'
     else case when event_id % 2 = 0 then 'cancel_requested' else 'cancelled' end end as status,
cast(event_id % 4 as int) as attempts,
concat('/u/', cast(user_id as string), '.pdf') as upload_path,
{ep} as created_at, {ep} + value as updated_at,
case when event_id % 7 = 0 then null else {ep} + value end as heartbeat_at"""

PROGRESS = """
cast(event_id as string) as job_id, cast({k} as int) as current,
case when event_id % 11 = 0 then 0 else cast(1 + event_id % 90 as int) end as total, event_type as message"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*items(JOBS.format(ep=EPOCH)))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_id % 4 <> 0").selectExpr(*items(PROGRESS.format(k="get_json_object(props, '$.k')")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a page: doc_id, page_index, text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("page_index", "text"))


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of files in a folder tree."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def items(sql: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, quoted, item = [], 0, False, ""
    for c in sql:
        quoted ^= c == "'"
        depth += ((c == "(") - (c == ")")) * (not quoted)
        if c == "," and depth == 0 and not quoted:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [*out, item.strip()]


#: The same tables for DuckDB, as common table expressions.
DUCK_EPOCH = "(epoch_us(ts) / 1e6::DOUBLE)"
DUCK = {
    "jobs": f"jobs AS (SELECT {JOBS.format(ep=DUCK_EPOCH)} FROM events)",
    "progress": "progress AS (SELECT " + PROGRESS.format(k="json_extract_string(props, '$.k')") + " FROM events WHERE event_id % 4 <> 0)",
    "pages": "pages AS (SELECT doc_id, unnest(range(len(lines)))::INT AS page_index, unnest(lines) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))",
}


def duck(sql: str, *tables: str) -> str:
    return "WITH " + ", ".join(DUCK[t] for t in tables) + " " + sql
