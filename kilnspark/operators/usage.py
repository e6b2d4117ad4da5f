"""Usage events: contract, consent, repeats, progress, repair attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Known events and the parameters each may carry.
CONTRACT = {
    "custom_page_view": ["page_type", "page_name", "page_title"],
    "tool_open": ["tool"],
    "cta_click": ["cta", "surface"],
    "processing_mode_selected": ["tool", "mode"],
    "input_selected": ["tool", "input_type", "count"],
    "processing_started": ["tool", "mode"],
    "processing_completed": ["tool", "mode", "result_type"],
    "processing_failed": ["tool", "mode", "error_category"],
    "result_downloaded": ["tool", "result_type"],
    "offer_viewed": ["offer_id"],
    "offer_redeemed": ["offer_id", "result"],
    "mock_api_project_created": ["surface", "mode"],
    "mock_api_collection_changed": ["surface", "mode"],
    "mock_api_request_simulated": ["surface", "mode", "method"],
    "mock_api_local_saved": ["surface", "mode"],
    "mock_api_local_host_started": ["surface", "mode"],
    "mock_api_project_deleted": ["surface", "mode"],
}
CONSENT_SECONDS = 6 * 30 * 24 * 60 * 60


def event_contract(events: DataFrame, contract: dict[str, list[str]] | None = None) -> DataFrame:
    """events(event, params map<string,string>) that the contract knows, with the parameters it lists.

    count is rounded and clamped to 0..100; other values are trimmed and cut at
    80 characters; empty ones go.
    """
    rules = events.sparkSession.createDataFrame(list((contract or CONTRACT).items()), "event string, _allowed array<string>")
    known = events.join(F.broadcast(rules), "event")  # a contract is written by hand
    listed = F.map_filter("params", lambda k, v: F.array_contains("_allowed", k) & v.isNotNull())
    number = lambda v: F.least(F.lit(100), F.greatest(F.lit(0), F.floor(v.try_cast("double") + 0.5))).cast("string")
    clean = F.transform_values(listed, lambda k, v: F.when(k == "count", number(v)).otherwise(F.substring(F.trim(v), 1, 80)))
    return known.withColumn("params", F.map_filter(clean, lambda k, v: F.coalesce(v != "", F.lit(False)))).drop("_allowed")


def consent_gate(events: DataFrame, consents: DataFrame, version: str, seconds: int = CONSENT_SECONDS) -> DataFrame:
    """events(subject, ts) whose subject's latest consent(ts, version, state) by then is granted and valid.

    As-of by a union and a running last value; a consent at the very time of an
    event counts.
    """
    marks = consents.select("subject", "ts", F.lit(0).alias("_kind"), F.struct(F.col("ts").alias("at"), "version", "state").alias("_c"))
    own = events.columns
    every = events.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("subject").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = every.withColumn("_last", F.last("_c", ignorenulls=True).over(w)).where("_kind = 1")
    ok = (F.col("_last.state") == "granted") & (F.col("_last.version") == version) & (F.col("ts") < F.col("_last.at") + F.make_interval(secs=F.lit(seconds)))
    return seen.where(ok).select(*own)


def drop_repeats(views: DataFrame, subject: str, path: str, order: list[str]) -> DataFrame:
    """Views whose path differs from the subject's view before."""
    before = F.lag(path).over(Window.partitionBy(subject).orderBy(*order))
    return views.withColumn("_before", before).where(~F.col(path).eqNullSafe(F.col("_before"))).drop("_before")


def drop_repeated_tools(views: DataFrame, subject: str, tool: str, order: list[str]) -> DataFrame:
    """Tool views whose tool differs from the last tool seen, other views between or not."""
    w = Window.partitionBy(subject).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(tool, ignorenulls=True).over(w)
    return views.withColumn("_last", last).where(F.col(tool).isNotNull() & ~F.col(tool).eqNullSafe(F.col("_last"))).drop("_last")


def monotone_progress(df: DataFrame, key: str, order: list[str], value: str, cap: float = 100) -> DataFrame:
    """df with shown: the progress, never falling, capped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("shown", F.least(F.lit(cap), F.max(value).over(w)))


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """Per key the first usable attempt(priority, method, ran, usable), or why there is none."""
    best = F.min_by("method", F.when(F.col("ran") & F.col("usable"), F.col("priority")))
    ran = F.count_if(F.col("ran"))
    return attempts.groupBy(key).agg(best.alias("method"), ran.alias("tried")).withColumn("failure", F.when(F.col("method").isNotNull(), None).when(F.col("tried") == 0, "no method available").otherwise("no usable output"))


def media_duration(streams: DataFrame, key: str) -> DataFrame:
    """The longest positive declared duration, else the last packet time that isn't negative."""
    return streams.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("declared") > 0, F.col("declared"))), F.max(F.when(F.col("packet") >= 0, F.col("packet")))).alias("duration"))


def collect_warnings(rows: DataFrame, key: str) -> DataFrame:
    """Distinct warnings(pass, ord, warning) of each key in the order first seen."""
    firsts = rows.groupBy(key, "warning").agg(F.min(F.struct("pass", "ord")).alias("at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))
