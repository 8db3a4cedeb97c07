"""The queries over whole tables, and the same questions in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import markup as M
from ..functions import text as X
from ..operators import headings, jobs, layout, messages, profile, requests
from ..sources import fixtures
from .register import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

# Cut-offs come from the data: the last creation less fifteen days.
SPAN = 86_400 * 15
TERMINAL = "('done', 'error', 'cancelled')"


def select_list(sql: str) -> list[str]:
    """The items of SELECT items FROM table."""
    return fixtures.items(sql[len("SELECT ") : sql.rindex(" FROM ")])


def now_of(table: DataFrame) -> float:
    return float((table.agg(F.max("created_at")).first()[0] or 0.0) - SPAN)


NOW = f"(SELECT max(created_at) - {SPAN} FROM jobs)"

# -------------------------------------------------- profiling and routing

DUCK_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PAGE = f"page AS (SELECT doc_id, page_index, length(regexp_replace(text, '{DUCK_SPACE}', '', 'g')) AS chars, length(text) - length(replace(text, chr(65533), '')) AS fffd FROM pages)"
DOC = f"{PAGE}, doc AS (SELECT doc_id, count(*) AS total, count(*) FILTER (chars >= 50) AS digital_pages, count(*) FILTER (chars < 50) AS raster_pages, sum(fffd)::BIGINT AS fffd, sum(chars)::BIGINT AS chars FROM page GROUP BY doc_id)"
ROUTE = "CASE WHEN total > 0 AND digital_pages / total::DOUBLE >= 0.9 THEN 'docling' ELSE 'vl' END"


def with_pages(sql: str, doc: str = DOC) -> str:
    return f"WITH {fixtures.DUCK['pages']}, {doc} {sql}"


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.document_profile(profile.page_profile(fixtures.pages(spark, sf_dir)))


@query(with_pages("SELECT doc_id, page_index, chars, fffd, chars >= 50 AS digital FROM page", PAGE))
def page_profile(spark, sf_dir):
    return profile.page_profile(fixtures.pages(spark, sf_dir))


@query(with_pages(f"SELECT doc_id, total, digital_pages, raster_pages, fffd, chars, {ROUTE} AS route FROM doc"))
def route_documents(spark, sf_dir):
    return document_profiles(spark, sf_dir).select("doc_id", "total", "digital_pages", "raster_pages", "fffd", "chars", profile.markdown_route().alias("route"))


@query(with_pages("SELECT doc_id, total > 0 AND raster_pages = 0 AND NOT (chars > 0 AND fffd / chars::DOUBLE > 0.05) AS searchable FROM doc"))
def already_searchable(spark, sf_dir):
    return document_profiles(spark, sf_dir).select("doc_id", profile.already_searchable().alias("searchable"))


ROUTED = f"route AS (SELECT doc_id, {ROUTE} AS route FROM doc), job AS (SELECT j.*, r.route FROM jobs j LEFT JOIN route r ON CAST(j.id AS BIGINT) = r.doc_id)"


def routed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = document_profiles(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), profile.markdown_route().alias("route"))
    return fixtures.jobs(spark, sf_dir).join(routes, "id", "left")


FAMILY = (
    "CASE mode WHEN 'pdf' THEN 'ppocr' WHEN 'markdown' THEN CASE engine WHEN 'vl' THEN 'vl' WHEN 'docling' THEN CASE WHEN upload_path IS NOT NULL AND route = 'docling' THEN 'docling' END "
    "ELSE CASE WHEN upload_path IS NULL THEN 'vl' ELSE coalesce(route, 'vl') END END ELSE 'vl' END"
)


@query(f"WITH {fixtures.DUCK['jobs']}, {fixtures.DUCK['pages']}, {DOC}, {ROUTED} SELECT id, {FAMILY} AS family, CASE WHEN {FAMILY} IS NULL THEN 'docling_ineligible' END AS problem FROM job")
def family_routing(spark, sf_dir):
    return routed_jobs(spark, sf_dir).select("id", profile.family(F.col("route")).alias("family"), profile.family_error(F.col("route")).alias("problem"))


@query(
    f"WITH {fixtures.DUCK['jobs']}, {fixtures.DUCK['pages']}, {DOC}, {ROUTED} SELECT w.id AS word_id, m.id AS markdown_id, "
    "CASE m.engine WHEN 'vl' THEN true WHEN 'docling' THEN false ELSE coalesce(m.route = 'vl', false) END AS co_produce FROM job w JOIN job m ON w.group_id = m.group_id WHERE w.mode = 'word' AND m.mode = 'markdown'"
)
def sibling_decision(spark, sf_dir):
    routed = routed_jobs(spark, sf_dir)
    pairs = profile.siblings(routed).join(routed.select(F.col("id").alias("markdown_id"), "route"), "markdown_id")
    return pairs.select("word_id", "markdown_id", profile.co_produce(F.col("engine"), F.col("route")).alias("co_produce"))


@query("SELECT o_orderkey, CASE WHEN w * 1.5 * h * 1.5 > 4840000 THEN greatest(0.4, 1.5 * sqrt(4840000 / (w * 1.5 * h * 1.5))) ELSE 1.5 END AS area_zoom, least(1.5, 4000 / greatest(w, h)) AS edge_zoom FROM (SELECT o_orderkey, (400 + o_custkey)::DOUBLE AS w, (500 + o_orderkey % 4000)::DOUBLE AS h FROM orders)")
def page_zooms(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 400).cast("double").alias("w"), (F.col("o_orderkey") % 4000 + 500).cast("double").alias("h"))
    return rows.select("o_orderkey", profile.zoom_for_area(F.lit(1.5), F.col("w"), F.col("h"), 4_840_000).alias("area_zoom"), profile.zoom_for_edge(F.lit(1.5), F.col("w"), F.col("h")).alias("edge_zoom"))


# -------------------------------------------------------------- job views

PERCENT = "CASE WHEN total > 0 THEN least(100, CAST(trunc(current / total::DOUBLE * 100) AS INT)) ELSE 0 END"


@query(f"SELECT id, status, current, total, CASE WHEN job_id IS NOT NULL THEN {PERCENT} END AS percent, message FROM jobs LEFT JOIN progress ON id = job_id", "jobs", "progress")
def jobs_with_progress(spark, sf_dir):
    out = jobs.with_progress(fixtures.jobs(spark, sf_dir), fixtures.progress(spark, sf_dir))
    return out.select("id", "status", "progress.current", "progress.total", "progress.percent", "progress.message")


@query("SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 200", "jobs")
def recent_jobs(spark, sf_dir):
    return jobs.recent(fixtures.jobs(spark, sf_dir)).select("id", "status", "created_at")


@query(f"SELECT id, status, created_at FROM jobs WHERE status NOT IN {TERMINAL} ORDER BY created_at, id", "jobs")
def active_jobs(spark, sf_dir):
    return jobs.active(fixtures.jobs(spark, sf_dir)).select("id", "status", "created_at").orderBy("created_at", "id")


@query("SELECT id, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1", "jobs")
def claim_next(spark, sf_dir):
    return jobs.next_claim(fixtures.jobs(spark, sf_dir)).select("id", "created_at")


@query(f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status NOT IN {TERMINAL}) AS active, CASE WHEN count(*) FILTER (status = 'queued') >= 100 THEN 'queue_full' WHEN count(*) FILTER (status NOT IN {TERMINAL}) >= 20 THEN 'too_many_active_jobs' END AS refusal FROM jobs", "jobs")
def queue_admission(spark, sf_dir):
    return jobs.admission(fixtures.jobs(spark, sf_dir))


@query(f"SELECT id, upload_path, sum(CASE WHEN status IN {TERMINAL} THEN 0 ELSE 1 END) OVER (PARTITION BY upload_path)::BIGINT - CASE WHEN status IN {TERMINAL} THEN 0 ELSE 1 END AS others FROM jobs", "jobs")
def upload_refcounts(spark, sf_dir):
    return jobs.other_references(fixtures.jobs(spark, sf_dir))


UPLOAD = "concat('/u/', CAST(id AS BIGINT) % 5000, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '.part' ELSE '.pdf' END)"


@query(f"SELECT path, max(created_at) AS modified FROM (SELECT {UPLOAD} AS path, created_at FROM jobs) WHERE path NOT IN (SELECT upload_path FROM jobs) GROUP BY path HAVING max(created_at) < {NOW}", "jobs")
def orphan_uploads(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    files = table.groupBy(F.expr(UPLOAD).alias("path")).agg(F.max("created_at").alias("modified"))
    return jobs.orphans(files, table, now_of(table))


@query(f"SELECT id, CASE WHEN status <> 'done' THEN 'not_found' END AS download, CASE WHEN status <> 'done' THEN 'not_found' WHEN mode <> 'markdown' THEN 'not_previewable' END AS preview FROM jobs", "jobs")
def output_access(spark, sf_dir):
    return jobs.accessible(fixtures.jobs(spark, sf_dir).withColumn("result_json", F.lit("{}")))


@query("SELECT group_id, id, count(*) OVER (PARTITION BY group_id) AS members FROM jobs WHERE group_id IS NOT NULL", "jobs")
def group_sizes(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir).where("group_id is not null")
    return table.select("group_id", "id").join(table.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")), "group_id")


@query("SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('minute', ts) AS minute, count(*) AS requests, greatest(0, count(*) - 60) AS refused FROM events GROUP BY ALL")
def rate_limited(spark, sf_dir):
    return jobs.rate_limited(fixtures.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts"))


STATUS = "(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'cancelled' END)"


@query(f"SELECT * FROM (SELECT user_id AS job, event_id AS seq, {STATUS} AS status, lag({STATUS}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE status IN {TERMINAL} AND before <> status")
def status_changes(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "events").selectExpr("user_id as job", "event_id as seq", f"{STATUS} as status")
    return jobs.completions(rows)


@query("SELECT user_id AS job, max(event_id) AS seq, arg_max(event_type, event_id) AS message FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    return jobs.latest(fixtures.read(spark, sf_dir, "events").selectExpr("user_id as job", "event_id as seq", "event_type as message"), "job", "seq")


#: What the watchdog sees: heartbeats and cancels some seconds before now, on both sides of the limits; of a pair the even member is claimed; progress with statuses.
WATCHED = "SELECT *, CAST(id AS BIGINT) % 2 = 0 OR group_id IS NULL AS claimed, CAST(id AS BIGINT) % 41 AS cancelled_ago, CAST(id AS BIGINT) % 2411 AS beat_ago FROM jobs"
PHASE = "CASE message WHEN 'view' THEN 'saving' WHEN 'click' THEN 'converting' ELSE 'processing' END"


@query(
    f"WITH {fixtures.DUCK['jobs']}, {fixtures.DUCK['progress']}, w AS ({WATCHED}), r AS (SELECT coalesce(nullif(group_id, ''), concat('job:', id)) AS watched, CASE WHEN CAST(id AS BIGINT) % 7 > 0 THEN beat_ago END AS beat_ago, claimed OR status NOT IN {TERMINAL} AS at_work, status, cancelled_ago, {PHASE} AS phase FROM w LEFT JOIN progress ON id = job_id), "
    "g AS (SELECT watched, min(beat_ago) AS beat_ago, count(*) FILTER (at_work) > 0 AND count(*) FILTER (at_work AND status <> 'cancel_requested') = 0 AS all_cancelled, min(cancelled_ago) FILTER (at_work) AS cancelled_ago, count(*) FILTER (phase IN ('saving', 'converting')) > 0 AS in_save FROM r GROUP BY watched) "
    "SELECT watched, all_cancelled, in_save, CASE WHEN in_save THEN 1800 ELSE 300 END AS idle_limit, CASE WHEN all_cancelled AND cancelled_ago > 15 THEN 'CANCELLED' WHEN beat_ago > CASE WHEN in_save THEN 1800 ELSE 300 END THEN 'TIMEOUT' END AS verdict FROM g"
)
def watchdog_limits(spark, sf_dir):
    now = 1_000_000.0
    table = fixtures.jobs(spark, sf_dir).selectExpr("*", "cast(id as bigint) % 2 = 0 or group_id is null as claimed", f"{now} - cast(id as bigint) % 41 as cancel_at")
    table = table.withColumn("heartbeat_at", F.expr(f"case when cast(id as bigint) % 7 > 0 then {now} - cast(id as bigint) % 2411 end"))
    state = fixtures.progress(spark, sf_dir).withColumn("status", F.expr(PHASE))
    return jobs.watch_limits(table, state, now).select("watched", "all_cancelled", "in_save", "idle_limit", "verdict")


@query(f"SELECT max(age) < 30 AS alive, CASE WHEN max(age) < 30 THEN 'ok' ELSE 'degraded' END AS status FROM (SELECT {NOW} - max(heartbeat_at) AS age FROM jobs)", "jobs")
def worker_health(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.healthy(table.agg(F.max("heartbeat_at").alias("updated_at")), now_of(table))


# ------------------------------------------------------------ transitions

STALE = f"(heartbeat_at IS NULL OR heartbeat_at < {NOW} - 120)"
ENDS = f"(status = 'cancel_requested' AND (group_id IN (SELECT group_id FROM jobs WHERE status = 'cancel_requested' AND {STALE} AND group_id IS NOT NULL) OR group_id IS NULL AND {STALE}))"
OLD = f"(status = 'processing' AND {STALE})"


@query(
    f"SELECT id, CASE WHEN {ENDS} THEN 'cancelled' WHEN {OLD} AND attempts + 1 >= 3 THEN 'error' WHEN {OLD} THEN 'queued' ELSE status END AS status, CASE WHEN {OLD} AND attempts + 1 < 3 THEN attempts + 1 ELSE attempts END AS attempts, "
    f"CASE WHEN {OLD} AND attempts + 1 >= 3 THEN 'interrupted too many times' END AS error, CASE WHEN {OLD} AND attempts + 1 < 3 THEN NULL ELSE heartbeat_at END AS heartbeat_at, CASE WHEN {ENDS} OR {OLD} THEN {NOW} ELSE updated_at END AS updated_at FROM jobs",
    "jobs",
)
def reap_transitions(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.reap(table, now_of(table)).select("id", "status", "attempts", "error", "heartbeat_at", "updated_at")


TENTH = "CAST(id AS BIGINT) % 10 = 3"


@query(
    f"SELECT id, CASE WHEN hit AND attempts + 1 >= 3 THEN 'error' WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit AND attempts + 1 < 3 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN hit AND attempts + 1 >= 3 THEN 'inference process crashed' END AS error, "
    f"CASE WHEN hit AND attempts + 1 < 3 THEN NULL ELSE heartbeat_at END AS heartbeat_at FROM (SELECT *, {TENTH} AND status NOT IN {TERMINAL} AS hit FROM jobs)",
    "jobs",
)
def requeue_after_crash(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.requeue(table, table.where("cast(id as bigint) % 10 = 3").select("id"), "inference process crashed", now_of(table)).select("id", "status", "attempts", "error", "heartbeat_at")


@query("SELECT id, CASE WHEN status IN ('queued', 'processing', 'saving') THEN 'queued' ELSE status END AS status, attempts, CASE WHEN status IN ('queued', 'processing', 'saving') THEN NULL ELSE heartbeat_at END AS heartbeat_at FROM jobs", "jobs")
def drain_requeue(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.drain(table, now_of(table)).select("id", "status", "attempts", "heartbeat_at")


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 3 AND status = 'queued' THEN 'processing' ELSE status END AS status FROM jobs", "jobs")
def promote_siblings(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.promote(table, table.where("cast(id as bigint) % 10 = 3").select("id"), now_of(table)).select("id", "status")


CANCELLED = f"after AS (SELECT id, CASE WHEN {TENTH} AND status NOT IN {TERMINAL} THEN CASE status WHEN 'queued' THEN 'cancelled' ELSE 'cancel_requested' END ELSE status END AS status FROM jobs)"


@query(f"WITH {fixtures.DUCK['jobs']}, {CANCELLED} SELECT id, status FROM after")
def cancel_requests(spark, sf_dir):
    return _cancel(spark, sf_dir)[0].select("id", "status")


@query(f"WITH {fixtures.DUCK['jobs']}, {fixtures.DUCK['progress']}, {CANCELLED} SELECT job_id, CASE WHEN {TENTH.replace('id AS', 'job_id AS')} AND job_id NOT IN (SELECT id FROM after WHERE status IN {TERMINAL}) THEN 'cancel_requested' ELSE 'queued' END AS status FROM progress")
def cancel_progress(spark, sf_dir):
    return _cancel(spark, sf_dir)[1].select("job_id", "status")


def _cancel(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    state = fixtures.progress(spark, sf_dir).withColumn("status", F.lit("queued"))
    return jobs.request_cancel(table, state, table.where("cast(id as bigint) % 10 = 3").select("id"), now_of(table))


GONE = f"(status IN {TERMINAL} AND updated_at < {NOW} - 7200)"


@query(f"SELECT id, status, updated_at FROM jobs WHERE NOT {GONE}", "jobs")
def gc_survivors(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.collect_garbage(table, fixtures.progress(spark, sf_dir), now_of(table))[0].select("id", "status", "updated_at")


@query(f"SELECT job_id, current, total FROM progress WHERE job_id NOT IN (SELECT id FROM jobs WHERE {GONE})", "jobs", "progress")
def progress_cascade(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    return jobs.collect_garbage(table, fixtures.progress(spark, sf_dir), now_of(table))[1].select("job_id", "current", "total")


@query(f"SELECT j.id, j.status FROM jobs j WHERE j.created_at < {NOW} AND j.status NOT IN {TERMINAL} AND j.id NOT IN (SELECT id FROM jobs WHERE status NOT IN {TERMINAL} AND CAST(id AS BIGINT) % 2 = 0)", "jobs")
def snapshot_difference(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    before = jobs.active(table.where(F.col("created_at") < now_of(table)))
    return jobs.snapshot_diff(before, jobs.active(table).where("cast(id as bigint) % 2 = 0"), table).select("id", "status")


@query(f"SELECT id, CASE WHEN {TENTH} THEN 'done' ELSE status END AS status, CASE WHEN {TENTH} THEN concat('d', id) END AS download_id, CASE WHEN {TENTH} THEN concat('{{\"totalPages\":', attempts, ',\"downloadId\":\"d', id, '\"}}') END AS result_json FROM jobs", "jobs")
def store_results(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    done = table.where("cast(id as bigint) % 10 = 3").select("id", F.concat(F.lit("d"), "id").alias("download_id"), F.struct(F.col("attempts").alias("totalPages"), F.concat(F.lit("d"), "id").alias("downloadId"), F.lit(None).cast("string").alias("warning")).alias("result"))
    return jobs.finish(table, done, now_of(table)).select("id", "status", "download_id", "result_json")


@query(f"SELECT id AS job_id, t AS current, t AS total, CASE WHEN t > 0 THEN 100 ELSE 0 END AS percent, status FROM (SELECT id, status, CASE WHEN status = 'done' THEN greatest(1, attempts) ELSE 0 END AS t FROM jobs WHERE status IN {TERMINAL})", "jobs")
def final_progress(spark, sf_dir):
    ended = fixtures.jobs(spark, sf_dir).where(jobs.is_terminal()).select("id", "status", F.lit("").alias("message"), F.col("attempts").alias("totalPages"))
    return jobs.final_progress(ended, 0.0).select("job_id", "current", "total", "percent", "status")


OWN = "CASE WHEN status IN ('processing', 'cancel_requested') THEN ['CANCELLED', 'DRAIN', 'TIMEOUT', 'DEAD'][CAST(id AS BIGINT) % 4 + 1] ELSE '' END"


@query(
    f"WITH {fixtures.DUCK['jobs']}, o AS (SELECT *, {OWN} AS own FROM jobs), p AS (SELECT *, group_id IS NOT NULL AND bool_or(own IN ('CANCELLED', 'DRAIN')) OVER (PARTITION BY group_id) AS stop, group_id IS NOT NULL AND bool_or(own = 'DRAIN') OVER (PARTITION BY group_id) AS drained FROM o), "
    f"e AS (SELECT *, own = 'CANCELLED' AND status NOT IN {TERMINAL} OR status = 'cancel_requested' AND (stop OR own = 'DRAIN') AS ends, status IN ('queued', 'processing', 'saving') AND (drained OR own = 'DRAIN') AS drains FROM p), "
    f"a AS (SELECT *, drains AND NOT ends AS again, own IN ('TIMEOUT', 'DEAD') AND status NOT IN {TERMINAL} AND NOT ends AND NOT drains AS crashed FROM e) "
    "SELECT id, CASE WHEN ends THEN 'cancelled' WHEN again THEN 'queued' WHEN crashed AND attempts >= 2 THEN 'error' WHEN crashed THEN 'queued' ELSE status END AS status, CASE WHEN crashed AND attempts < 2 THEN attempts + 1 ELSE attempts END AS attempts, "
    "CASE WHEN crashed AND attempts >= 2 THEN CASE own WHEN 'TIMEOUT' THEN 'inference timed out' ELSE 'inference process crashed' END END AS error FROM a"
)
def supervisor_outcomes(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir)
    verdict = F.element_at(F.array(*(F.lit(x) for x in ("CANCELLED", "DRAIN", "TIMEOUT", "DEAD"))), (F.col("id").cast("long") % 4 + 1).cast("int"))
    watched = table.where("status in ('processing', 'cancel_requested')").select("id", verdict.alias("verdict"))
    return jobs.handle_outcome(table, watched, now_of(table)).select("id", "status", "attempts", "error")


@query(f"SELECT id, status FROM jobs WHERE status IN {TERMINAL}", "jobs")
def clearable_jobs(spark, sf_dir):
    return jobs.clearable(fixtures.jobs(spark, sf_dir)).select("id", "status")


@query(f"SELECT concat('/v/', CAST(id AS BIGINT) % 700) AS upload_path FROM jobs GROUP BY 1 HAVING count(*) FILTER (status NOT IN {TERMINAL}) = 0", "jobs")
def unused_uploads(spark, sf_dir):
    table = fixtures.jobs(spark, sf_dir).withColumn("upload_path", F.concat(F.lit("/v/"), (F.col("id").cast("long") % 700).cast("string")))
    return jobs.unused_uploads(table)


@query("SELECT doc_id, array_to_string(list_sort(list(page_index + 1)), ',') AS failed_pages FROM pages WHERE (doc_id + page_index) % 7 = 0 GROUP BY doc_id", "pages")
def failed_pages(spark, sf_dir):
    rows = fixtures.pages(spark, sf_dir).withColumn("failed", (F.col("doc_id") + F.col("page_index")) % 7 == 0)
    return jobs.failed_pages(rows).select("doc_id", F.array_join(F.col("failed_pages").cast("array<string>"), ",").alias("failed_pages"))


@query("SELECT doc_id, page_index + 1 AS current, count(*) OVER (PARTITION BY doc_id) AS total, least(100, CAST(trunc((page_index + 1) / (count(*) OVER (PARTITION BY doc_id))::DOUBLE * 100) AS INT)) AS percent FROM pages", "pages")
def page_steps(spark, sf_dir):
    return jobs.page_steps(fixtures.pages(spark, sf_dir).select("doc_id", "page_index"))


@query("SELECT user_id AS id, max(event_id) AS seq FROM events GROUP BY user_id")
def submission_order(spark, sf_dir):
    return jobs.submission_order(fixtures.read(spark, sf_dir, "events").selectExpr("user_id as id", "event_id as seq"))


@query(
    "SELECT id, CASE mode WHEN 'pdf' THEN CASE locale WHEN 'en' THEN 'Page ' || attempts || ' of {total}' ELSE '第 ' || attempts || ' 頁' END WHEN 'word' THEN '完成' ELSE 'odd_key' END AS message FROM jobs",
    "jobs",
)
def localized_messages(spark, sf_dir):
    held = [("page", "zh-TW", "第 {current} 頁"), ("page", "en", "Page {current} of {total}"), ("done", "zh-TW", "完成")]
    table = spark.createDataFrame(held, "key string, locale string, template string")
    key = F.when(F.col("mode") == "pdf", "page").when(F.col("mode") == "word", "done").otherwise("odd_key")
    rows = fixtures.jobs(spark, sf_dir).withColumn("key", key)
    return messages.localized(rows, table, current=F.col("attempts")).select("id", "message")


# ---------------------------------------------------------------- requests

REQUEST = "SELECT event_id, CASE event_type WHEN 'signup' THEN 'markdown, word,markdown' WHEN 'view' THEN 'pdf' WHEN 'error' THEN 'pdf,odt' WHEN 'purchase' THEN ' ,' ELSE 'word, pdf' END AS modes, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN 'zh-CN' END AS locale, CASE user_id % 5 WHEN 0 THEN 'vl' WHEN 1 THEN 'magic' WHEN 2 THEN 'auto' END AS engine FROM events"


def _requests(spark, sf_dir):
    return requests.validate(fixtures.read(spark, sf_dir, "events").selectExpr(*select_list(REQUEST)))


VALID = f"""WITH r AS ({REQUEST}), s AS (SELECT *, list_filter(list_transform(string_split(modes, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM r),
v AS (SELECT event_id, CASE WHEN len(items) > 0 AND len(list_filter(items, lambda x: x NOT IN ('pdf', 'markdown', 'word'))) = 0 THEN list_filter(items, lambda x, i: list_position(items, x) = i) END AS mode_list,
CASE WHEN locale IN ('zh-TW', 'zh-CN', 'en') THEN locale ELSE 'zh-TW' END AS locale, coalesce(engine, 'auto') AS engine FROM s),
w AS (SELECT *, CASE WHEN mode_list IS NULL THEN 'invalid_modes' WHEN engine NOT IN ('auto', 'docling', 'vl') THEN 'invalid_engine' WHEN engine <> 'auto' AND NOT list_contains(mode_list, 'markdown') THEN 'engine_requires_markdown_mode' END AS problem FROM v)"""


@query(f"{VALID} SELECT event_id, array_to_string(mode_list, ',') AS mode_list, locale, engine, problem FROM w")
def validate_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("event_id", F.array_join("mode_list", ",").alias("mode_list"), "locale", "engine", "problem")


@query(
    f"{VALID} SELECT concat(event_id, '-', mode) AS id, CASE WHEN list_contains(mode_list, 'markdown') AND list_contains(mode_list, 'word') AND mode <> 'pdf' THEN concat('g', event_id) END AS group_id, mode, locale, CASE WHEN mode = 'markdown' THEN engine ELSE 'auto' END AS engine "
    "FROM (SELECT *, unnest(mode_list) AS mode FROM w WHERE problem IS NULL)"
)
def fan_out_jobs(spark, sf_dir):
    files = _requests(spark, sf_dir).where("problem is null").select(F.col("event_id").alias("file_id"), "mode_list", "locale", "engine", F.lit("a.pdf").alias("filename"))
    return requests.fan_out(files).select("id", "group_id", "mode", "locale", "engine")


FILES = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('Doc ', page_id, '.PDF') WHEN 1 THEN concat('doc', page_id, '.pdf') ELSE concat('pic', page_id, '.png') END AS filename, length(html) > 3000 AS truncated, CASE WHEN page_id % 7 = 0 THEN 'encrypted_pdf' END AS reason FROM pages"


def _files(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").selectExpr(*select_list(FILES))


@query(f"SELECT page_id, filename, CASE WHEN truncated THEN 'too_large' WHEN NOT lower(filename) LIKE '%.pdf' THEN 'unsupported' ELSE reason END AS skipped FROM ({FILES})")
def split_accepted(spark, sf_dir):
    taken, skipped = requests.split_accepted(_files(spark, sf_dir))
    return taken.withColumn("skipped", F.lit(None).cast("string")).unionByName(skipped).select("page_id", "filename", "skipped")


@query("SELECT min(o_orderkey) AS seq, concat(o_custkey, '.pdf') AS name FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus")
def unique_files(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("name"), F.col("o_orderpriority").alias("size"), F.col("o_orderstatus").alias("last_modified"), F.lit(None).cast("string").alias("mime"), F.col("o_orderkey").alias("seq"))
    return requests.unique_files(rows).select("seq", "name")


@query("SELECT folder, name, size, sum(size) OVER w::BIGINT AS running, sum(size) OVER w > 20000 AS too_large FROM (SELECT source AS folder, concat('f', lpad(doc_id::VARCHAR, 9, '0'), CASE WHEN doc_id % 5 = 0 THEN '.DOCX' ELSE '.md' END) AS name, n_chars AS size FROM documents) WHERE NOT lower(name) LIKE '%.docx' WINDOW w AS (PARTITION BY folder ORDER BY name ROWS UNBOUNDED PRECEDING)")
def zip_budget(spark, sf_dir):
    name = F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.when(F.col("doc_id") % 5 == 0, ".DOCX").otherwise(".md"))
    return requests.zip_budget(fixtures.read(spark, sf_dir, "documents").select(F.col("source").alias("folder"), name.alias("name"), F.col("n_chars").alias("size")), 20_000)


@query("SELECT conv_id AS folder, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def merged_markdown(spark, sf_dir):
    return requests.merged_markdown(fixtures.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("folder"), F.col("turn").alias("name"), "text"))


@query("SELECT page_id, name FROM (SELECT page_id, concat('imgs/', page_id, ['.png', '.JPG', '.md', '.webp', ''][page_id % 5 + 1]) AS name FROM pages) WHERE page_id % 5 IN (0, 1, 3)")
def image_listing(spark, sf_dir):
    name = F.concat(F.lit("imgs/"), F.col("page_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".png", ".JPG", ".md", ".webp", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return requests.images(fixtures.read(spark, sf_dir, "pages").select("page_id", name.alias("name")))


# -------------------------------------------------------------------- text

@query("SELECT doc_id, regexp_replace(regexp_replace(t, '([㐀-鿿豈-﫿])[ \\t]+([㐀-鿿豈-﫿])', '\\1\\2', 'g'), '([㐀-鿿豈-﫿])[ \\t]+([㐀-鿿豈-﫿])', '\\1\\2', 'g') AS text FROM (SELECT doc_id, replace(replace(text, 'th', '中 文' || chr(9) || '字'), 'en', '年 ') AS t FROM documents)")
def strip_cjk(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("th"), F.lit("中 文\t字")), F.lit("en"), F.lit("年 "))
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", X.strip_han_spaces(t).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html FROM pages")
def entity_decode(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").select("page_id", X.entities(F.col("html")).alias("html"))


@query(r"SELECT doc_id, span, NOT regexp_matches(span, '[\\^_{}]') AND NOT (length(span) >= 4 AND regexp_matches(substr(span, 2, length(span) - 2), '^\s') AND regexp_matches(substr(span, 2, length(span) - 2), '\s$')) AS money FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\$[^$\n]+\$')) AS span FROM documents)")
def verbatim_currency(spark, sf_dir):
    spans = fixtures.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$[^$\n]+\$"), F.lit(0))).alias("span"))
    return spans.select("doc_id", "span", X.is_plain_dollars(F.col("span")).alias("money"))


@query(r"""SELECT doc_id, CASE WHEN n = '' THEN 'download' ELSE n END AS name FROM (SELECT doc_id, CASE WHEN length(n) > 200 THEN regexp_replace(substr(n, 1, 200), '[\s._]+$', '') ELSE n END AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), '"', ''''), '[\\/]', '_', 'g'), '[_\s]+', '_', 'g'), '^[\s._]+|[\s._]+$', '', 'g') AS n FROM documents))""")
def download_names(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", X.download_name(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN concat(printf('%.1f', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10), ' KB') ELSE concat(printf('%.1f', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10), ' MB') END AS label FROM (SELECT doc_id, n_chars * 37 AS b FROM documents)")
def size_labels(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", X.size_label(F.col("n_chars") * 37).alias("label"))


@query("SELECT user_id, event_id, ['en', 'zh-CN', 'zh-TW', 'zh-TW', 'zh-TW', 'zh-CN', 'en', 'zh-TW'][event_id % 8 + 1] AS locale FROM events")
def normal_locales(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("en_US", " zh-Hans ", "ZH-tw", "fr", "", "zh_SG", "english", "zh-hant-HK"))), (F.col("event_id") % 8 + 1).cast("int"))
    return fixtures.read(spark, sf_dir, "events").select("user_id", "event_id", X.normal_locale(raw).alias("locale"))


@query("SELECT event_id, least(64, greatest(1, event_id % 100))::INT AS span FROM events")
def cell_spans(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "events").select("event_id", X.cell_span(F.concat(F.lit(" "), (F.col("event_id") % 100).cast("string"), F.lit("位"))).alias("span"))


@query(r"SELECT page_id, regexp_replace(concat('a.', url), '\.[^.]+$', '') AS stem, CASE WHEN page_id % 3 = 0 THEN 'skip_too_large' WHEN page_id % 3 = 1 THEN 'skip_too_many_files' ELSE 'skip_unknown' END AS reason, concat('Page ', page_id, ' of {total}') AS message FROM pages")
def names_and_messages(spark, sf_dir):
    reason = F.element_at(F.array(F.lit("too_large"), F.lit("too_many_files (max 20 per request)"), F.lit("odd")), (F.col("page_id") % 3 + 1).cast("int"))
    message = X.fill(F.lit("Page {page} of {total}"), page=F.col("page_id"))
    return fixtures.read(spark, sf_dir, "pages").select("page_id", X.stem(F.concat(F.lit("a."), "url")).alias("stem"), X.skip_reason_key(reason).alias("reason"), message.alias("message"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag, CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id::INT END AS number, CASE event_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu:0' ELSE 'gpu:1' END AS device FROM events")
def environment_values(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), (e % len(x) + 1).cast("int"))
    number = F.when(e % 3 == 0, "7x").otherwise(e.cast("string"))
    return fixtures.read(spark, sf_dir, "events").select("event_id", X.env_bool(pick("YES", "0", " on ", "off"), False).alias("flag"), X.env_int(number, 7).alias("number"), X.device(pick("CPU:0", " auto", "gpu:1")).alias("device"))


PARAGRAPHS = "SELECT doc_id, page_index AS seq, text, 12 + 2 * (page_index % 4) AS size, page_index % 2 = 0 AS bold, CASE WHEN page_index % 8 = 6 THEN 'justify' ELSE 'left' END AS alignment FROM pages"


@query(
    f"WITH {fixtures.DUCK['pages']}, p AS (SELECT *, bold AND size >= 13.5 AND alignment <> 'justify' AS heading FROM ({PARAGRAPHS}) WHERE regexp_replace(text, '{DUCK_SPACE}', '', 'g') <> ''), "
    "s AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) FILTER (heading) > 0 AND count(*) FILTER (heading) <= count(*) * 0.5) SELECT doc_id, seq, least(4, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC))::INT AS level FROM p JOIN s USING (doc_id) WHERE heading"
)
def heading_levels(spark, sf_dir):
    return headings.heading_levels(fixtures.pages(spark, sf_dir).selectExpr(*select_list(PARAGRAPHS)))


# ------------------------------------------------------------------ layout


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page result: its lines as texts, scored and placed by their number."""
    docs = fixtures.read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("rec_texts"))
    scores = F.transform("rec_texts", lambda t, i: F.lit(0.3) + (i % 8) * F.lit(0.1))
    top = lambda i: (i * 20 + i % 3).cast("double")
    left = lambda i: (i % 5 * 40).cast("double")
    right = lambda t, i: left(i) + F.length(t) * 8.0
    polys = F.transform("rec_texts", lambda t, i: F.array(F.array(left(i), top(i)), F.array(right(t, i), top(i)), F.array(right(t, i), top(i) + 12.0), F.array(left(i), top(i) + 12.0)))
    return docs.select("doc_id", F.lit(0).alias("page_index"), "rec_texts", scores.alias("rec_scores"), polys.alias("rec_polys"))


LINES = f"line AS (SELECT doc_id, page_index AS line, text, 0.3::DOUBLE + (page_index % 8) * 0.1::DOUBLE AS score, (page_index % 5 * 40)::DOUBLE AS x0, (page_index * 20 + page_index % 3)::DOUBLE AS y0, page_index % 5 * 40 + length(text) * 8.0::DOUBLE AS x1 FROM pages WHERE regexp_replace(text, '{DUCK_SPACE}', '', 'g') <> '' AND 0.3::DOUBLE + (page_index % 8) * 0.1::DOUBLE >= 0.5)"


@query(f"WITH {fixtures.DUCK['pages']}, {LINES} SELECT doc_id, line, text, score FROM line")
def ocr_gate(spark, sf_dir):
    return layout.gate(ocr_results(spark, sf_dir)).select("doc_id", "line", "text", "score")


@query(f"WITH {fixtures.DUCK['pages']}, {LINES} SELECT doc_id, line, x0, y0, x1, y0 + 12 AS y1 FROM line")
def token_bbox(spark, sf_dir):
    return layout.gate(ocr_results(spark, sf_dir)).select("doc_id", "line", layout.box(F.col("poly")).alias("b")).select("doc_id", "line", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"WITH {fixtures.DUCK['pages']}, {LINES} SELECT doc_id, line, y0 AS top, y0 + 12 AS bottom, x0 AS \"left\" FROM line")
def line_extent(spark, sf_dir):
    return layout.line_extents(layout.gate(ocr_results(spark, sf_dir))).select("doc_id", "line", "top", "bottom", "left")


@query(f"WITH {fixtures.DUCK['pages']}, {LINES} SELECT doc_id, list_sort(list(x1 - x0))[len(list(x1 - x0)) // 2 + 1] AS width FROM line GROUP BY doc_id")
def line_widths(spark, sf_dir):
    rows = layout.gate(ocr_results(spark, sf_dir)).withColumn("b", layout.box(F.col("poly")))
    return rows.groupBy("doc_id").agg(layout.upper_median(F.collect_list(F.col("b.x1") - F.col("b.x0"))).alias("width"))


# Lines of this input lie 20 apart and are 12 high, so no two share a row and they follow their tops.
@query(f"WITH {fixtures.DUCK['pages']}, {LINES} SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0) - 1)::INT AS \"order\" FROM line")
def reading_order(spark, sf_dir):
    return layout.in_reading_order(layout.gate(ocr_results(spark, sf_dir))).select("doc_id", "line", "order")


@query()
def line_runs(spark, sf_dir):
    items = layout.gate(ocr_results(spark, sf_dir)).withColumn("words", F.filter(F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0)), lambda w: w != ""))
    ends = F.aggregate("words", F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + F.length(w)))
    rows = items.withColumn("b", layout.box(F.col("poly"))).withColumn("ends", ends)
    x = lambda k: F.col("b.x0") + F.element_at("ends", k) * 8.0 + k % 3 * 3
    regions = F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.array(F.array(x(k), F.col("b.y0")), F.array(x(k) + 8.0, F.col("b.y1"))))
    runs = layout.line_runs_column("text", "words", regions, F.col("b.x0"), F.col("b.x1"))
    return rows.select("doc_id", "line", F.posexplode(runs).alias("run", "r")).select("doc_id", "line", "run", "r.text", "r.x0", "r.x1")


@query()
def latex_render(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", M.latex_column(F.concat("text", F.lit(" $x^{2}$ costs $5 and $8mm^{2}$"))).alias("text"))


# Each row has a cell A that spans r rows and, behind it, a cell B that spans c columns. held counts, by column, the rows that a cell above still takes:
# A takes the first free column, B the next free one, columns in between and right behind B are taken over from above.
TABLE_ROWS = """o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, o_custkey % 3 + 1 AS r, o_orderkey % 2 + 1 AS c, o_orderstatus AS a, printf('%.2f', o_totalprice) || ' \\| ' || o_orderpriority AS b FROM orders),
g(o_custkey, nth, held, line) AS (
  SELECT DISTINCT o_custkey, 0::BIGINT, [0 FOR x IN range(16)]::BIGINT[], []::VARCHAR[] FROM o
  UNION ALL
  SELECT o_custkey, nth, list_transform(range(16), lambda x: CASE WHEN x = j1 AND r > 1 THEN r - 1 WHEN x < j1 OR x > j1 AND x < j2 OR x >= j2 + c AND x < j3 THEN held[x + 1] - 1 ELSE held[x + 1] END),
    list_transform(range(j3), lambda x: CASE x WHEN j1 THEN a WHEN j2 THEN b ELSE ' ' END)
  FROM (SELECT *, list_min(list_filter(range(17), lambda x: x >= j2 + c AND coalesce(held[x + 1], 0) = 0)) AS j3 FROM (SELECT *, list_min(list_filter(range(16), lambda x: x > j1 AND held[x + 1] = 0)) AS j2 FROM (
    SELECT o.*, g.held, list_min(list_filter(range(16), lambda x: g.held[x + 1] = 0)) AS j1 FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.nth = g.nth + 1))))"""


@query(
    f"WITH RECURSIVE {TABLE_ROWS}, w AS (SELECT o_custkey, max(len(line)) AS width FROM g GROUP BY o_custkey), l AS (SELECT o_custkey, nth, width, '| ' || array_to_string(list_transform(range(width), lambda x: coalesce(line[x + 1], ' ')), ' | ') || ' |' AS t FROM g JOIN w USING (o_custkey) WHERE nth > 0) "
    "SELECT o_custkey, chr(10) || chr(10) || string_agg(CASE nth WHEN 1 THEN t || chr(10) || '|' || repeat(' --- |', width::INT) ELSE t END, chr(10) ORDER BY nth) || chr(10) || chr(10) AS markdown FROM l GROUP BY o_custkey"
)
def html_tables_to_markdown(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "orders")
    cell = F.format_string("<tr><td rowspan='%d'>%s</td><td colspan=\"%d\">%.2f | %s</td></tr>", (F.col("o_custkey") % 3 + 1).cast("int"), F.col("o_orderstatus"), (F.col("o_orderkey") % 2 + 1).cast("int"), F.col("o_totalprice"), F.col("o_orderpriority"))
    tables = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("c")))), lambda x: x["c"]), "").alias("body"))
    return tables.select("o_custkey", M.table_column(F.concat(F.lit("<table>"), "body", F.lit("</table>"))).alias("markdown"))


@query()
def process_markdown(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").select("page_id", M.markdown_column("html").alias("markdown"))


from . import states  # noqa: E402, F401  registers the rest
