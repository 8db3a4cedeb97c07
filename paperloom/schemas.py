"""Schemas, value domains and constants of the document-processing data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: DDL of the tables.
JOBS = (
    "id string, group_id string, mode string, filename string, locale string, engine string, status string, attempts int, upload_path string, "
    "download_id string, result_json string, error string, created_at double, updated_at double, heartbeat_at double"
)
#: What the watchdog knows of a job besides.
WATCHED = "claimed boolean, cancel_at double, heartbeat_at double"
PROGRESS = "job_id string, current int, total int, percent int, status string, message string, updated_at double"
HEARTBEAT = "id int, updated_at double, active_model string, gpu_json string"
RESULT = "struct<totalPages:int,downloadId:string,imagesCount:int,originalName:string,warning:string,engine:string,notice:string>"

# The domains of the enumerated columns.
MODES = ("pdf", "markdown", "word")
LOCALES = ("zh-TW", "zh-CN", "en")
ENGINES = ("auto", "docling", "vl")
STATUSES = ("queued", "processing", "saving", "cancel_requested", "done", "error", "cancelled")
TERMINAL = ("done", "error", "cancelled")
SAVE_PHASES = ("saving", "converting")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg")

# Thresholds of profiling and layout, limits of the job table.
DIGITAL_MIN_CHARS, DIGITAL_RATIO, MOJIBAKE_RATIO = 50, 0.9, 0.05
MAX_SPAN = 64
HEADING_MIN_PT, HEADING_LEVELS, HEADING_FRACTION = 13.5, 4, 0.5
MIN_SCORE = 0.5
ROW_OVERLAP, TALL = 0.35, 1.6
INK_LEVEL, INVERTED, INK_PEAK = 160, 0.55, 0.04
MARKER_GAP, DRIFT, DRIFT_PX = 0.35, 0.15, 4.0
STRETCH, STRETCH_PLAIN = 8.0, 4.0
STALE_S, MAX_ATTEMPTS, MAX_AGE_S = 120, 3, 7200
IDLE_S, SAVE_IDLE_S, CANCEL_GRACE_S, WORKER_STALE_S = 300, 1800, 15, 30
QUEUE_CAP, ACTIVE_CAP, RATE = 100, 20, 60
ZIP_CAP = 200 * 1024 * 1024
PARSED_BYTES, TAIL_BYTES = 100 * 1024 * 1024, 64 * 1024


def evolve(df: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with every column of the schema: those it lacks are added with their default (null without one). Nothing is dropped or retyped.

    Running it twice changes nothing. The added columns follow the existing ones in the schema's order.
    """
    have = {c.lower() for c in df.columns}
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        if name.lower() not in have:
            df = df.withColumn(name, F.lit((defaults or {}).get(name)).cast(kind))
    return df
