"""Job and request ledgers: views, retention, updates, claims, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.operators.ranked import running_sum

MIB = 1024 * 1024
HOUR, MINUTE, DAY = 3_600_000, 60_000, 86_400_000


def option(name: str, column: str = "options") -> Column:
    """A text option of a JSON column; null if the JSON is malformed."""
    return F.try_variant_get(F.try_parse_json(column), f"$.{name}", "string")


def job_by_id(jobs: DataFrame, job_id: object) -> DataFrame:
    return jobs.where(F.col("id") == F.lit(job_id))


def completed_jobs(jobs: DataFrame, tool: str) -> DataFrame:
    return jobs.where((F.col("status") == "completed") & (F.col("tool") == tool)).orderBy(F.desc("updated_at"), "id")


def retained_jobs(jobs: DataFrame, tool: str) -> DataFrame:
    """Completed jobs of a tool whose options say keep; malformed options don't."""
    return jobs.where((F.col("status") == "completed") & (F.col("tool") == tool) & (option("retention") == "keep")).orderBy(F.desc("created_at"), "id")


def public_view(jobs: DataFrame) -> DataFrame:
    """Jobs without their result path, with links once there is a result, and unknown values as null."""
    there = F.col("result_path").isNotNull()
    link = lambda what: F.when(there, F.concat(F.lit("/api/jobs/"), F.col("id").cast("string"), F.lit(what)))
    return jobs.withColumns({
        "download_url": F.when(there, link("/download")),
        "preview_url": F.when(there, link("/preview")),
        "history_status": F.when(F.lower(option("historyStatus")) == "saved", "saved").otherwise("completed"),
        "conversion_progress": F.nullif("conversion_progress", F.lit(-1)),
    }).drop("result_path")


def history_search(jobs: DataFrame, text: str = "", status: str = "completed", size: str = "", sort: str = "newest") -> DataFrame:
    """jobs(id, filename, location, storage, status, size, created_at) by text, status and size class, sorted.

    size: small (under 1 MiB), medium, large (10 MiB or more); sort: newest, oldest, name, size.
    """
    bucket = F.when(F.col("size") < MIB, "small").when(F.col("size") < 10 * MIB, "medium").otherwise("large")
    found = jobs.where(F.col("status") == status).withColumn("size_class", bucket)
    if text:
        found = found.where(F.lower(F.concat_ws(" ", "filename", "location", "storage")).contains(text.lower()))
    if size:
        found = found.where(F.col("size_class") == size)
    return found.orderBy({"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "name": F.asc("filename"), "size": F.desc("size")}[sort], "id")


def claim_order(jobs: DataFrame, queue: str = "tool") -> DataFrame:
    """Queued jobs with their turn in each queue, oldest first."""
    return running_sum(jobs.where("status = 'queued'"), [queue], [F.col("created_at"), F.col("id")], F.lit(1), "turn").withColumn("turn", F.col("turn") + 1)


def log_tail(logs: DataFrame, key: str, order: list[str], n: int = 250) -> DataFrame:
    """The last n log lines of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return logs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def latest_state(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def create_jobs(rows: DataFrame, now: Column) -> DataFrame:
    return rows.select("*", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit("Queued").alias("stage"), now.alias("created_at"), now.alias("updated_at"))


def apply_updates(base: DataFrame, changes: DataFrame, settable: list[str] = ["message", "error"]) -> DataFrame:  # noqa: B006
    """base with its changes(id, seq, ts, status, stage, progress, <settable> struct(set, value)) folded in.

    Empty status and stage and null progress leave the old value; a settable
    field that is set takes its value, null too. The last change counts, so
    this is an aggregate of ordered structs and needs no loop.
    """
    last = lambda value, given: F.max_by(value, F.when(given, F.col("seq")))
    sums = [last(F.col(c), F.coalesce(F.col(c), F.lit("")) != "").alias(f"_{c}") for c in ("status", "stage")]
    sums += [last(F.col("progress"), F.col("progress").isNotNull()).alias("_progress"), F.max("ts").alias("_ts")]
    for c in settable:
        sums += [F.max_by(F.col(c)["value"], F.when(F.col(c)["set"], F.col("seq"))).alias(f"_{c}"), F.coalesce(F.max(F.col(c)["set"]), F.lit(False)).alias(f"_{c}_set")]
    new = changes.groupBy("id").agg(*sums)
    both = base.join(new, "id", "left")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("status", "stage", "progress")}
    out |= {c: F.when(F.col(f"_{c}_set"), F.col(f"_{c}")).otherwise(F.col(c)) for c in settable}
    out["updated_at"] = F.coalesce("_ts", "updated_at")
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in base.columns])


def fail_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that were being processed become failed."""
    hit = F.col("status") == "processing"
    return jobs.withColumns({"stage": F.when(hit, "Interrupted").otherwise(F.col("stage")), "progress": F.when(hit, 100).otherwise(F.col("progress")), "status": F.when(hit, "failed").otherwise(F.col("status"))})


def expire_jobs(jobs: DataFrame, now: Column, hours: float = 2, spare_kept: bool = False) -> DataFrame:
    """Jobs without those that ended before the cutoff; kept ones may be spared."""
    old = F.col("status").isin("completed", "failed") & (F.col("updated_at") < now - int(hours * HOUR))
    if spare_kept:
        old = old & F.coalesce(option("retention") != "keep", F.lit(True))
    return jobs.where(~old)


def cancel_jobs(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked(id) jobs those in process become cancelled, the others go."""
    marked = jobs.join(asked.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
    hit = F.coalesce("_asked", F.lit(False))
    return marked.where(~hit | (F.col("status") == "processing")).withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_asked")


def upsert_settings(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value, ts): the newest value of each key; a change beats the base at equal times."""
    every = base.select("key", "value", "ts", F.lit(0).alias("_new")).unionByName(changes.select("key", "value", "ts", F.lit(1).alias("_new")))
    return every.groupBy("key").agg(F.max_by("value", F.struct("ts", "_new")).alias("value"), F.max("ts").alias("ts"))


def retention_action(now: Column) -> Column:
    """What a sweep does to a request(status, created_at, updated_at, expires_at, redeemed_at): expire, delete or keep."""
    return (
        F.when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expire")
        .when((F.col("status") == "redeemed") & (F.col("redeemed_at") + HOUR <= now), "delete")
        .when((F.col("status") == "declined") & (F.col("updated_at") + 30 * MINUTE <= now), "delete")
        .when((F.col("status") == "approved") & (F.col("updated_at") + 24 * HOUR <= now), "delete")
        .otherwise("keep")
    )


def cleanup_counts(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """One row: how many requests a sweep expires and deletes, and sessions it ends."""
    acted = requests.withColumn("action", retention_action(now))
    hit = lambda action, status: F.count_if((F.col("action") == action) & (F.col("status") == status))
    counts = acted.agg(hit("expire", "pending").alias("expired_pending"), hit("delete", "redeemed").alias("deleted_redeemed"), hit("delete", "declined").alias("deleted_declined"), hit("delete", "approved").alias("deleted_approved"))
    return counts.withColumn("ended_sessions", sessions.agg(F.count_if(F.col("expires_at") <= now)).scalar())


def evolve_schema(df: DataFrame, target: dict[str, tuple[str, object]]) -> DataFrame:
    """df with the target's missing columns, name to (type, default); present ones stay."""
    return df.withColumns({name: F.lit(default).cast(kind) for name, (kind, default) in target.items() if name not in df.columns})


def replay_check(redemptions: DataFrame, used: DataFrame, approved: DataFrame) -> DataFrame:
    """redemptions(license_id, code_hash, seq) with refused: a reason or null.

    An id already in used(license_id), one that is not approved with that code
    hash, and each but the first redemption of an id in the batch are refused.
    """
    first = F.row_number().over(Window.partitionBy("license_id").orderBy("seq"))
    known = redemptions.withColumn("_turn", first).join(used.select("license_id", F.lit(True).alias("_used")).distinct(), "license_id", "left")
    known = known.join(approved.select("license_id", F.col("code_hash").alias("_hash")), "license_id", "left")
    reason = F.when(F.col("_used"), "used").when(F.col("_hash").isNull() | (F.col("_hash") != F.col("code_hash")), "unknown").when(F.col("_turn") > 1, "replayed")
    return known.withColumn("refused", reason).drop("_turn", "_used", "_hash")


def verify_tokens(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests(id, token_hash) whose token, from tokens(id, token), hashes to theirs."""
    return requests.join(tokens.select("id", F.sha2("token", 256).alias("token_hash")), ["id", "token_hash"], "left_semi")


def existing_results(jobs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Jobs whose result_path lies under the root and is in files(path)."""
    return jobs.where(F.startswith("result_path", F.lit(root.rstrip("/") + "/"))).join(files.select(F.col("path").alias("result_path")), "result_path", "left_semi")


def supersede(jobs: DataFrame, replacements: DataFrame) -> DataFrame:
    """jobs(id, tool, status, retention, result_path, created_at) after replacements(old_id, new_id).

    A pair counts if both have one tool and the old job is completed and kept:
    the old loses its path and is to be deleted, the new is kept and takes over
    the old one's creation time.
    """
    old = jobs.select(F.col("id").alias("old_id"), F.col("tool").alias("_tool"), F.col("created_at").alias("_created"), "status", "retention").where("status = 'completed' and retention = 'keep'").drop("status", "retention")
    pairs = replacements.join(old, "old_id").join(jobs.select(F.col("id").alias("new_id"), "tool"), "new_id").where("tool = _tool")
    both = jobs.join(pairs.select(F.col("old_id").alias("id"), F.col("new_id").alias("superseded_by")), "id", "left").join(pairs.select(F.col("new_id").alias("id"), "_created"), "id", "left")
    gone, new = F.col("superseded_by").isNotNull(), F.col("_created").isNotNull()
    return both.withColumns({"retention": F.when(gone, "delete").when(new, "keep").otherwise(F.col("retention")), "result_path": F.when(~gone, F.col("result_path")), "created_at": F.coalesce("_created", "created_at")}).drop("_created")


def batch_progress(jobs: DataFrame, batch: str) -> DataFrame:
    return jobs.groupBy(batch).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(F.col("status").isin("completed", "failed")).alias("finished"))


def recent(df: DataFrame, n: int = 200, order: str = "created_at") -> DataFrame:
    """The newest n rows."""
    return df.orderBy(F.desc(order), F.desc("id")).limit(n)


def sessions_by_age(sessions: DataFrame, own_id: object) -> DataFrame:
    return sessions.withColumn("own", F.col("id") == F.lit(own_id)).orderBy(F.desc("created_at"), "id")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions 12 h after their creation at most (strictly before), labels cleaned to 80 characters."""
    from kilnspark.functions.scalars import clean_label

    return sessions.withColumn("expires_at", F.col("created_at") + 12 * HOUR).where(~(F.col("expires_at") < now)).withColumn("label", clean_label(F.col("label"), 80))


def health_rollup(checks: DataFrame, key: str) -> DataFrame:
    """ok unless an item has failed; warnings don't fail."""
    return checks.groupBy(key).agg(F.bool_and(F.col("status") != "fail").alias("ok"), F.count_if(F.col("status") == "warn").alias("warnings"))


def effective_remaining(remaining: Column, sessions: Column) -> Column:
    """What is left when more than two sessions share it: two thirds for each further one."""
    return F.floor(remaining * F.pow(F.lit(2 / 3), F.greatest(F.lit(0), sessions - 2))).cast("long")


def consent_accepted(terms_at: Column, privacy_at: Column, terms: Column, privacy: Column, current: str) -> Column:
    """When both documents were accepted at the current version: the earlier time, else null."""
    return F.when((terms == current) & (privacy == current), F.least(terms_at, privacy_at))


def authorization_mode(consent: Column, admin: Column, activated_at: Column, remaining_ms: Column, logged_in: Column, trial_started: Column, now: Column) -> Column:
    """struct(mode, reason), first rule that holds: no consent, admin, live activation, trial of five minutes, locked."""
    alive = activated_at.isNotNull() & (remaining_ms > 0)
    trial = ~F.coalesce(alive, F.lit(False)) & (trial_started.isNull() | (now < trial_started + 5 * MINUTE))
    mode = F.when(~consent, "locked").when(admin, "admin").when(alive & logged_in, "active").when(trial, "trial").otherwise("locked")
    reason = F.when(~consent, "consent").when(admin, "admin").when(alive & logged_in, "activation").when(trial, "trial").when(alive, "logged out").otherwise("expired")
    return F.struct(mode.alias("mode"), reason.alias("reason"))


def promo_open(issued: Column, now: Column) -> Column:
    """Within both windows of a code, of 90 and of 60 days."""
    return now < F.least(issued + 90 * DAY, issued + 60 * DAY)
