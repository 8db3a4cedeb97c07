"""The job table: views, counts and state transitions as projections of whole tables.

A transition takes the table and returns it with the rows changed that the rule names; ``now`` is always given, never read from a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S

STALE = "heartbeat_at is null or heartbeat_at < {cutoff}"


def is_terminal(status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status).isin(*S.TERMINAL)


def percent(current: Column, total: Column) -> Column:
    """current of total in whole hundredths, cut off and not rounded, at most 100; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), (current / total * 100).cast("int"))).otherwise(0)


# ------------------------------------------------------------------ views


def with_progress(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Every job with its progress as a struct, null where it has none; the key is unique on the right."""
    p = progress.select("job_id", "current", "total", percent(F.col("current"), F.col("total")).alias("percent"), "message")
    out = jobs.join(p, jobs["id"] == p["job_id"], "left")
    return out.withColumn("progress", F.when(F.col("job_id").isNotNull(), F.struct("current", "total", "percent", "message"))).drop("job_id", "current", "total", "percent", "message")


def view(jobs: DataFrame) -> DataFrame:
    """The camel-case view of a job, its result parsed."""
    jobs = S.evolve(jobs, S.JOBS, {"engine": "auto", "attempts": 0})
    return jobs.select("id", F.col("group_id").alias("groupId"), "mode", "filename", "locale", "engine", "status", "progress", F.from_json("result_json", S.RESULT).alias("result"), "error", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"))


def recent(jobs: DataFrame, n: int = 200) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(n)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(~is_terminal())


def completed(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'done'")


def group_members(jobs: DataFrame, group: str | None) -> DataFrame:
    return jobs.where(F.col("group_id") == group) if group is not None else jobs.limit(0)


# ------------------------------------------------------------------ counts


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(~is_terminal()).alias("active"))


def admission(jobs: DataFrame, queue_cap: int = S.QUEUE_CAP, active_cap: int = S.ACTIVE_CAP) -> DataFrame:
    return queue_counts(jobs).select("*", F.when(F.col("queued") >= queue_cap, "queue_full").when(F.col("active") >= active_cap, "too_many_active_jobs").alias("refusal"))


def other_references(jobs: DataFrame) -> DataFrame:
    """id, upload_path and how many other active jobs use that upload. Sums by upload are joined back, so a much used upload isn't one task."""
    used = jobs.groupBy("upload_path").agg(F.count_if(~is_terminal()).alias("used"))
    return jobs.join(used, "upload_path").select("id", "upload_path", (F.col("used") - F.when(is_terminal(), 0).otherwise(1)).alias("others"))


def uploads(jobs: DataFrame) -> DataFrame:
    return jobs.where("upload_path is not null").select("upload_path").distinct()


def orphans(files: DataFrame, jobs: DataFrame, cutoff: float) -> DataFrame:
    """Files (path, modified) older than the cutoff that no job refers to."""
    return files.join(uploads(jobs).withColumnRenamed("upload_path", "path"), "path", "left_anti").where(F.col("modified") < cutoff)


def watch_limits(jobs: DataFrame, progress: DataFrame, now: float, stopping: bool = False) -> DataFrame:
    """Per group (or single job): last heartbeat of any member, whether all members at work are to be cancelled and since when, whether one saves, the idle limit, the verdict.

    At work are the claimed member (``claimed``, where the table has it) and those that have not ended. ``cancel_at`` is when a member's cancel was first seen;
    a group is cancelled when the last of these is longer ago than the grace, and until then it may still time out. A stop of the whole worker goes before both.
    """
    key = F.coalesce(F.when(F.col("group_id") != "", F.col("group_id")), F.concat(F.lit("job:"), F.col("id")))
    jobs = S.evolve(jobs, S.WATCHED, {"claimed": False})
    at_work = F.coalesce("claimed", F.lit(False)) | ~is_terminal()
    phases = S.evolve(progress, S.PROGRESS).select(F.col("job_id").alias("id"), F.col("status").alias("phase"))
    rows = jobs.join(phases, "id", "left").groupBy(key.alias("watched")).agg(
        F.max("heartbeat_at").alias("last_heartbeat"),
        F.coalesce(F.bool_and(F.when(at_work, F.col("status") == "cancel_requested")), F.lit(False)).alias("all_cancelled"),
        F.max(F.when(at_work, F.col("cancel_at"))).alias("cancel_at"),
        F.coalesce(F.bool_or(F.col("phase").isin(*S.SAVE_PHASES)), F.lit(False)).alias("in_save"),
    )
    limit = F.when(F.col("in_save"), S.SAVE_IDLE_S).otherwise(S.IDLE_S)
    cancelled = F.col("all_cancelled") & (F.lit(now) - F.col("cancel_at") > S.CANCEL_GRACE_S)
    verdict = F.when(F.lit(stopping), "DRAIN").when(cancelled, "CANCELLED").when(F.lit(now) - F.col("last_heartbeat") > F.col("idle_limit"), "TIMEOUT")
    return rows.withColumn("idle_limit", limit).withColumn("verdict", verdict)


def healthy(heartbeats: DataFrame, now: float) -> DataFrame:
    alive = F.coalesce(F.max(F.lit(now) - F.col("updated_at") < S.WORKER_STALE_S), F.lit(False))
    return heartbeats.agg(alive.alias("alive")).withColumn("status", F.when(F.col("alive"), "ok").otherwise("degraded"))


def accessible(jobs: DataFrame) -> DataFrame:
    """For each job why its output can't be downloaded or previewed, if so."""
    ready = (F.col("status") == "done") & F.col("result_json").isNotNull()
    jobs = S.evolve(jobs, S.JOBS)
    return jobs.select("id", F.when(~ready, "not_found").alias("download"), F.when(~ready, "not_found").when(F.col("mode") != "markdown", "not_previewable").alias("preview"))


def rate_limited(requests: DataFrame, limit: int = S.RATE) -> DataFrame:
    """key, minute, requests, refused: requests (key, ts) over the limit in each minute."""
    n = requests.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("requests"))
    return n.withColumn("refused", F.greatest(F.lit(0), F.col("requests") - limit))


# ------------------------------------------------------------ transitions


def _set(jobs: DataFrame, when: Column, **values: Column) -> DataFrame:
    jobs = S.evolve(jobs, S.JOBS)
    return jobs.select(*(F.when(when, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns))


def enqueue(jobs: DataFrame, progress: DataFrame, new: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new jobs, queued, and their progress of nothing."""
    at = F.lit(float(now))
    rows = S.evolve(new, S.JOBS, {"engine": "auto"}).withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "created_at": at, "updated_at": at})
    zero = rows.select(F.col("id").alias("job_id"), *(F.lit(0).alias(c) for c in ("current", "total", "percent")), F.lit("queued").alias("status"), F.lit("").alias("message"), at.alias("updated_at"))
    return jobs.unionByName(rows, allowMissingColumns=True), progress.unionByName(zero, allowMissingColumns=True)


def claim(jobs: DataFrame, now: float) -> DataFrame:
    """The oldest queued job (of equals the smaller id) is processing. One row comes to the driver, which is the only writer."""
    got = jobs.where("status = 'queued'").orderBy("created_at", "id").select("id").limit(1).collect()
    if not got:
        return S.evolve(jobs, S.JOBS)
    return _set(jobs, F.col("id") == got[0]["id"], status=F.lit("processing"), heartbeat_at=F.lit(float(now)), updated_at=F.lit(float(now)))


def next_claim(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def reap(jobs: DataFrame, now: float, stale_s: float = S.STALE_S, most: int = S.MAX_ATTEMPTS) -> DataFrame:
    """Stale processing jobs are queued again with one more attempt, or fail at the last; stale cancels end, with their whole group's."""
    stale = F.expr(STALE.format(cutoff=f"cast('{now - stale_s!r}' as double)"))
    hit = jobs.where((F.col("status") == "cancel_requested") & stale).select("id", F.when(F.col("group_id") != "", F.col("group_id")).alias("group_id"))
    groups = hit.where("group_id is not null").select(F.col("group_id").alias("_g")).distinct()
    jobs = S.evolve(jobs, S.JOBS).join(groups, F.col("group_id") == F.col("_g"), "left")
    ends = (F.col("status") == "cancel_requested") & (F.col("_g").isNotNull() | (F.coalesce("group_id", F.lit("")) == "") & stale)
    old = (F.col("status") == "processing") & stale
    last, at = F.col("attempts") + 1 >= most, F.lit(float(now))
    out = {
        "status": F.when(ends, "cancelled").when(old & last, "error").when(old, "queued").otherwise(F.col("status")),
        "error": F.when(old & last, "interrupted too many times").otherwise(F.col("error")),
        "attempts": F.when(old & ~last, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "heartbeat_at": F.when(old & ~last, F.lit(None).cast("double")).otherwise(F.col("heartbeat_at")),
        "updated_at": F.when(ends | old, at).otherwise(F.col("updated_at")),
    }
    return jobs.select(*(out[c].alias(c) if c in out else F.col(c) for c in jobs.columns if c != "_g"))


def requeue(jobs: DataFrame, ids: DataFrame, reason: str, now: float, most: int = S.MAX_ATTEMPTS) -> DataFrame:
    """After a crash: jobs of ids that have not ended (a pending cancel is lost here) are queued again, or fail at the last attempt."""
    jobs = S.evolve(jobs, S.JOBS).join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    hit = F.col("_hit").isNotNull() & ~is_terminal()
    last, at = F.col("attempts") + 1 >= most, F.lit(float(now))
    out = _set(jobs, hit, status=F.when(last, "error").otherwise("queued"), error=F.when(last, reason).otherwise(F.col("error")), attempts=F.when(last, F.col("attempts")).otherwise(F.col("attempts") + 1), heartbeat_at=F.when(last, F.col("heartbeat_at")), updated_at=at)
    return out.drop("_hit")


def drain(jobs: DataFrame, now: float) -> DataFrame:
    """Shutdown: running jobs are queued again without counting an attempt; pending cancels stay."""
    return _set(jobs, F.col("status").isin("queued", "processing", "saving"), status=F.lit("queued"), heartbeat_at=F.lit(None).cast("double"), updated_at=F.lit(float(now)))


def promote(jobs: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """Queued siblings that a running pass produces are processing too."""
    jobs = S.evolve(jobs, S.JOBS).join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    return _set(jobs, F.col("_hit").isNotNull() & (F.col("status") == "queued"), status=F.lit("processing"), heartbeat_at=F.lit(float(now)), updated_at=F.lit(float(now))).drop("_hit")


def request_cancel(jobs: DataFrame, progress: DataFrame, ids: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Queued jobs are cancelled, running ones asked to stop, ended ones stay. Progress follows only for jobs that are then still running,
    so that of a job cancelled while queued keeps its old status."""
    jobs = S.evolve(jobs, S.JOBS).join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    after = _set(jobs, F.col("_hit").isNotNull() & ~is_terminal(), status=F.when(F.col("status") == "queued", "cancelled").otherwise("cancel_requested"), updated_at=F.lit(float(now)))
    asked = after.where(F.col("_hit").isNotNull() & ~is_terminal()).select(F.col("id").alias("_job"))
    progress = S.evolve(progress, S.PROGRESS).join(asked, F.col("job_id") == F.col("_job"), "left")
    hit = F.col("_job").isNotNull()
    progress = progress.withColumns({"status": F.when(hit, "cancel_requested").otherwise(F.col("status")), "updated_at": F.when(hit, float(now)).otherwise(F.col("updated_at"))}).drop("_job")
    return after.drop("_hit"), progress


def resolve_group(jobs: DataFrame, group: str | None, now: float) -> DataFrame:
    """Pending cancels of a group end; without a group nothing changes."""
    if not group:
        return S.evolve(jobs, S.JOBS)
    return _set(jobs, (F.col("group_id") == group) & (F.col("status") == "cancel_requested"), status=F.lit("cancelled"), updated_at=F.lit(float(now)))


def remove(jobs: DataFrame, progress: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the jobs."""
    gone = ids.select("id").distinct()
    return jobs.join(gone, "id", "left_anti"), progress.join(gone, progress["job_id"] == gone["id"], "left_anti")


def expired(jobs: DataFrame, cutoff: float) -> DataFrame:
    return jobs.where(is_terminal() & (F.col("updated_at") < cutoff))


def collect_garbage(jobs: DataFrame, progress: DataFrame, now: float, age: float = S.MAX_AGE_S) -> tuple[DataFrame, DataFrame]:
    return remove(jobs, progress, expired(jobs, now - age).select("id"))


def write_progress(jobs: DataFrame, progress: DataFrame, new: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Both tables with the progress of jobs (id, current, total, status, message) in place of what there was; each such job has shown life now."""
    at = F.lit(float(now))
    rows = new.select(F.col("id").alias("job_id"), "current", "total", percent(F.col("current"), F.col("total")).alias("percent"), "status", "message", at.alias("updated_at"))
    progress = S.evolve(progress, S.PROGRESS).join(rows.select("job_id"), "job_id", "left_anti").unionByName(rows, allowMissingColumns=True)
    jobs = S.evolve(jobs, S.JOBS).join(new.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    return _set(jobs, F.col("_hit").isNotNull(), heartbeat_at=at, updated_at=at).drop("_hit"), progress


def finish(jobs: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """Jobs with a result (id, download_id, result struct) are done."""
    r = results.select(F.col("id").alias("_hit"), F.col("download_id").alias("_d"), F.to_json("result").alias("_r"))
    jobs = S.evolve(jobs, S.JOBS).join(r, F.col("id") == F.col("_hit"), "left")
    return _set(jobs, F.col("_hit").isNotNull(), status=F.lit("done"), download_id=F.col("_d"), result_json=F.col("_r"), updated_at=F.lit(float(now))).drop("_hit", "_d", "_r")


def final_progress(ended: DataFrame, now: float) -> DataFrame:
    """Progress rows for jobs that ended (id, status, message, totalPages): all of all pages (one at least) when done, else nothing of nothing."""
    total = F.when(F.col("status") == "done", F.when(F.coalesce("totalPages", F.lit(0)) == 0, 1).otherwise(F.col("totalPages"))).otherwise(0)
    return ended.select(F.col("id").alias("job_id"), total.alias("current"), total.alias("total"), percent(total, total).alias("percent"), "status", "message", F.lit(float(now)).alias("updated_at"))


def fail(jobs: DataFrame, ids: DataFrame, status: str, message: str, now: float) -> DataFrame:
    jobs = S.evolve(jobs, S.JOBS).join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    return _set(jobs, F.col("_hit").isNotNull(), status=F.lit(status), error=F.lit(message) if status == "error" else F.col("error"), updated_at=F.lit(float(now))).drop("_hit")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log: an upsert. One aggregate with partial maxima, no window."""
    rest = [c for c in log.columns if c not in (key, order)]
    out = log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return out.select(key, F.col(f"_last.{order}"), *(F.col(f"_last.{c}") for c in rest))


def snapshot_diff(before: DataFrame, now_active: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that were active at the last tick and are no longer."""
    return before.select("id").join(now_active.select("id"), "id", "left_anti").join(jobs, "id")


def completions(events: DataFrame) -> DataFrame:
    """First changes into a terminal status in each job's order (job, seq, status); a job first seen ended is not a change."""
    w = Window.partitionBy("job").orderBy("seq")
    return events.withColumn("before", F.lag("status").over(w)).where(is_terminal() & F.col("before").isNotNull() & (F.col("before") != F.col("status")))


def handle_outcome(jobs: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """What becomes of watched jobs by verdict (id, verdict). CANCELLED: the job ends unless it already has, with its group's
    pending cancels. DRAIN: pending cancels of the group end, its running members are queued again. TIMEOUT and DEAD: ``requeue``."""
    by = outcomes.select(F.col("id").alias("_hit"), F.col("verdict").alias("_v"))
    groups = jobs.where("group_id <> ''").join(by, F.col("id") == F.col("_hit")).groupBy(F.col("group_id").alias("_g")).agg(F.bool_or(F.col("_v").isin("CANCELLED", "DRAIN")).alias("_stop"), F.bool_or(F.col("_v") == "DRAIN").alias("_drain"))
    rows = S.evolve(jobs, S.JOBS).join(by, F.col("id") == F.col("_hit"), "left").join(groups, F.col("group_id") == F.col("_g"), "left")
    own, pending = F.coalesce("_v", F.lit("")), F.col("status") == "cancel_requested"
    ends = (own == "CANCELLED") & ~is_terminal() | pending & (F.coalesce("_stop", F.lit(False)) | (own == "DRAIN"))
    again = F.col("status").isin("queued", "processing", "saving") & ~ends & (F.coalesce("_drain", F.lit(False)) | (own == "DRAIN"))
    crashed = own.isin("TIMEOUT", "DEAD") & ~is_terminal() & ~ends & ~again
    last, at = F.col("attempts") + 1 >= S.MAX_ATTEMPTS, F.lit(float(now))
    reason = F.when(own == "TIMEOUT", "inference timed out").otherwise("inference process crashed")
    out = _set(
        rows, ends | again | crashed,
        status=F.when(ends, "cancelled").when(crashed & last, "error").otherwise("queued"), attempts=F.when(crashed & ~last, F.col("attempts") + 1).otherwise(F.col("attempts")),
        error=F.when(crashed & last, reason).otherwise(F.col("error")), heartbeat_at=F.when(again | crashed & ~last, F.lit(None).cast("double")).otherwise(F.col("heartbeat_at")), updated_at=at,
    )
    return out.drop("_hit", "_v", "_g", "_stop", "_drain")


def backoff_ms(fails: Column, auth: Column) -> Column:
    return F.when(auth, 30_000).otherwise(F.least(F.lit(30_000), (F.lit(1000) * F.pow(F.lit(2), F.least(fails, F.lit(20)))).cast("int")))


def clearable(jobs: DataFrame) -> DataFrame:
    return jobs.where(is_terminal())


def unused_uploads(jobs: DataFrame) -> DataFrame:
    """Uploads that no active job uses."""
    used = jobs.groupBy("upload_path").agg(F.bool_or(~is_terminal()).alias("used"))
    return used.where("upload_path is not null and not used").select("upload_path")


def failed_pages(pages: DataFrame) -> DataFrame:
    """doc_id and the ascending numbers (from 1) of its pages (page_index, failed) that failed."""
    return pages.where("failed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("page_index") + 1)).alias("failed_pages"))


def page_steps(pages: DataFrame) -> DataFrame:
    """doc_id, current, total, percent after each page. Totals are joined, so that a document's pages are only counted together."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    rows = pages.join(total, "doc_id").withColumn("current", F.col("page_index") + 1)
    return rows.select("doc_id", "current", "total", percent(F.col("current"), F.col("total")).alias("percent"))


def submission_order(submissions: DataFrame) -> DataFrame:
    """Each id once, the latest submission (seq) first."""
    return submissions.groupBy("id").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "id")
