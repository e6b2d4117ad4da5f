"""Queries that write and read files, and streams over events and orders that end when all rows are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.functions import scalars as s
from kilnspark.plans.ledger_queries import JOBS_SQL, RATE_SQL, jobs, millis
from kilnspark.plans.registry import query
from kilnspark.sources import files
from kilnspark.sources.scratch import drained, scratch
from kilnspark.streaming import keyed, states


def streamed(df, name):
    """df's rows, written as Parquet, as a stream."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("s1_read_jobs", f"WITH {JOBS_SQL} SELECT id::VARCHAR AS id, tool, status, created_at, updated_at FROM jobs")
def s1(t):
    own = jobs(t).select(F.col("id").cast("string").alias("id"), "tool", "status", "created_at", "updated_at")
    spark, path = own.sparkSession, scratch(own.sparkSession, "jobs")
    own.write.parquet(path)
    return files.read_jobs(spark, path).select(own.columns)


#: Customers of a nation as a project; every fifth file is no JSON.
PROJECTS_SQL = "projects AS (SELECT c_nationkey AS n, count(*) AS records, '2024-' || lpad((c_nationkey % 12 + 1)::VARCHAR, 2, '0') AS updated_at FROM customer GROUP BY c_nationkey)"


def _projects(t):
    n = F.col("c_nationkey")
    own = t("customer").groupBy(n.cast("string").alias("project_id"), (n % 5 == 4).alias("bad"), F.concat(F.lit("2024-"), F.lpad((n % 12 + 1).cast("string"), 2, "0")).alias("updated_at")).agg(F.count("*").alias("records"))
    text = F.when(F.col("bad"), "{bad").otherwise(F.to_json(F.struct(F.col("updated_at").alias("updatedAt"), "records")))
    spark, path = own.sparkSession, scratch(own.sparkSession, "projects")
    own.select("project_id", text.alias("value")).repartition("project_id").write.partitionBy("project_id").text(path)
    return files.read_projects(spark, path, "*.txt")


@query("s2_read_projects", f"WITH {PROJECTS_SQL} SELECT n::VARCHAR AS project_id, updated_at, records FROM projects WHERE n % 5 <> 4")
def s2(t):
    return _projects(t).select("project_id", "updated_at", F.try_variant_get("doc", "$.records", "long").alias("records"))


@query("k4_projects_by_update", f"WITH {PROJECTS_SQL} SELECT n::VARCHAR AS project_id, updated_at FROM projects WHERE n % 5 <> 4 ORDER BY updated_at DESC, n::VARCHAR LIMIT 7")
def k4(t):
    """The seven projects changed last."""
    return files.projects_by_update(_projects(t)).limit(7).select("project_id", "updated_at")


@query("s3_write_projects", "SELECT o_orderpriority AS project_id, count(*) AS n, CASE WHEN o_orderpriority < '3' THEN 'new' ELSE 'old' END AS state FROM orders WHERE o_orderpriority >= '3' OR o_orderstatus = 'F' GROUP BY ALL")
def s3(t):
    """Two priorities' projects are written anew; the others stay."""
    own = t("orders").select(F.col("o_orderpriority").alias("project_id"), "o_orderstatus", F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("json"))
    spark, path = own.sparkSession, scratch(own.sparkSession, "project-tables")
    files.write_projects(own.select("project_id", "json", F.lit("old").alias("state")), path)
    files.write_projects(own.where("project_id < '3' and o_orderstatus = 'F'").select("project_id", "json", F.lit("new").alias("state")), path)
    return spark.read.parquet(path).groupBy(F.col("project_id").cast("string").alias("project_id"), "state").agg(F.count("json").alias("n"))


@query("s4_delete_project", "SELECT o_orderpriority AS project_id, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL")
def s4(t):
    return files.delete_project(t("orders").withColumnRenamed("o_orderpriority", "project_id"), "1-URGENT").groupBy("project_id").agg(F.count("*").alias("n"))


@query("s5_read_media", "SELECT lang, (sum(octet_length(encode(coalesce(text, ''))) + 1))::BIGINT AS n_bytes FROM documents GROUP BY lang")
def s5(t):
    """The documents of each language as files; what the listing says about their sizes."""
    own = t("documents").select("lang", F.coalesce("text", F.lit("")).alias("value"))
    spark, path = own.sparkSession, scratch(own.sparkSession, "media")
    own.write.partitionBy("lang").text(path)
    found = files.read_media(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(F.sum("size").alias("n_bytes"))


FEED_SQL = "feed AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'result' ELSE 'progress' END AS type, value AS progress FROM events)"


def _feed(t):
    return t("events").select(F.when(F.col("event_id") % 50 == 0, "result").otherwise("progress").alias("type"), F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("long").alias("seq"), F.col("value").alias("progress"), F.lit("m").alias("message"))


@query("s6_read_progress", f"WITH {FEED_SQL} SELECT * FROM feed")
def s6(t):
    own = _feed(t)
    spark, path = own.sparkSession, scratch(own.sparkSession, "feed")
    own.write.json(path)
    return drained(files.read_progress(spark, path), "progress").select("job_id", "seq", "type", "progress")


@query("s7_append_audit", "SELECT event_type, count(*) AS n, max(props::JSON->>'k') AS most FROM events GROUP BY event_type")
def s7(t):
    """Two appends, read back as one table."""
    own = t("events").select("event_id", "event_type", "props")
    spark, path = own.sparkSession, scratch(own.sparkSession, "audit")
    for k in (0, 1):
        files.append_audit(own.where(F.col("event_id") % 2 == k), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k")).alias("most"))


@query("x1_stream_job_state", "SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS status, arg_max(floor(value)::INT, event_id) FILTER (event_id % 3 = 0) AS progress FROM events GROUP BY user_id")
def x1(t):
    own = t("events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("status"), F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("int")).alias("progress"), F.lit("").alias("stage"))
    each = drained(states.stream_job_state(streamed(own, "changes")), "job-state", "update")
    return each.groupBy("id").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s")).select("id", F.nullif("s.status", F.lit("")).alias("status"), "s.progress")


@query("x2_stream_rate_limit", f'WITH RECURSIVE {RATE_SQL} SELECT user_id::VARCHAR AS key, ms::DOUBLE AS "at", ok AS accepted FROM f')
def x2(t):
    own = t("events").select(F.col("user_id").cast("string").alias("key"), millis("ts").cast("double").alias("at"))
    return drained(states.stream_rate_limit(streamed(own, "hits"), 3, 86_400_000.0, None), "rates").select("key", "at", "accepted")


#: Orders that change nothing after they were made; the watermark is a minute behind the last.
TIMED_SQL = "timed AS (SELECT o_orderkey::VARCHAR AS id, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS ms, CASE o_orderstatus WHEN 'F' THEN 'declined' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status FROM orders), mark AS (SELECT max(ms) - 60000 AS now FROM timed)"


def _timed(t):
    status = F.when(F.col("o_orderstatus") == "F", "declined").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return streamed(t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), status.alias("status")), "timed").withWatermark("ts", "1 minute")


@query("x3_stream_expiry", f"WITH {TIMED_SQL} SELECT id, status FROM timed, mark WHERE ms + CASE status WHEN 'declined' THEN 1800000 WHEN 'pending' THEN 86400000 END <= now")
def x3(t):
    return drained(states.stream_expiry(_timed(t)), "expiry").select("id", "status")


@query("x7_stream_stalled_jobs", f"WITH {TIMED_SQL} SELECT id, status FROM timed, mark WHERE status = 'processing' AND ms + 259200000 <= now")
def x7(t):
    return drained(states.stream_stalled_jobs(_timed(t), 3 * 86_400_000), "stalled").select("id", "status")


@query("x4_stream_consent_gate", """WITH m AS (SELECT user_id, event_id AS n, event_id % 10 = 0 AS consent, CASE WHEN event_id % 10 = 0 THEN event_id END AS since, CASE WHEN event_id % 20 = 0 THEN 'granted' ELSE 'denied' END AS state FROM events),
a AS (SELECT *, max(since) OVER (PARTITION BY user_id ORDER BY n) AS last FROM m)
SELECT user_id::VARCHAR AS subject, n::DOUBLE AS "at" FROM a WHERE NOT consent AND last % 20 = 0 AND n < last + 700""")
def x4(t):
    k = F.col("event_id")
    own = t("events").select(F.col("user_id").cast("string").alias("subject"), k.cast("double").alias("at"), F.when(k % 10 == 0, "consent").otherwise("event").alias("kind"), F.lit("v1").alias("version"), F.when(k % 20 == 0, "granted").otherwise("denied").alias("state"))
    return drained(states.stream_consent_gate(streamed(own, "marks"), "v1", 700), "gate").select("subject", "at")


@query("x5_stream_drop_repeats", 'SELECT user_id::VARCHAR AS subject, event_id::DOUBLE AS "at", event_type AS path FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type')
def x5(t):
    own = t("events").select(F.col("user_id").cast("string").alias("subject"), F.col("event_id").cast("double").alias("at"), F.col("event_type").alias("path"))
    return drained(states.stream_drop_repeats(streamed(own, "views")), "views-shown").select("subject", "at", "path")


@query("x5_changes_of_view", """WITH v AS (SELECT user_id::VARCHAR AS subject, event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_type END AS path, CASE WHEN event_type <> 'view' THEN event_type END AS tool FROM events),
b AS (SELECT *, lag(path) OVER w AS p, last_value(tool IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM v WINDOW w AS (PARTITION BY subject ORDER BY n))
SELECT subject, n AS "at", 'path' AS kind, path AS value FROM b WHERE p IS NULL OR p <> path UNION ALL SELECT subject, n, 'tool', tool FROM b WHERE tool IS NOT NULL AND (t IS NULL OR t <> tool)""")
def x5_values(t):
    """Changes of the path and of the last tool, which don't depend on each other."""
    path, tool = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_type")), F.when(F.col("event_type") != "view", F.col("event_type"))
    own = t("events").select(F.col("user_id").cast("string").alias("subject"), F.col("event_id").cast("long").alias("at"), path.alias("path"), tool.alias("tool"))
    return drained(keyed.changes_of_view(streamed(own, "views-and-tools")), "changes-of-view").select("subject", "at", "kind", "value")


#: The watermark is ten minutes behind the last event.
MARK_SQL = "u AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), mark AS (SELECT max(ms) - 600000 AS now FROM u)"


@query("x1_job_state_by_time", f"""WITH {MARK_SQL}, c AS (SELECT user_id::VARCHAR AS id, ms, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN event_type END AS s, CASE WHEN event_id % 3 = 0 THEN floor(value)::INT END AS p FROM u)
SELECT id, ms, seq, last_value(s IGNORE NULLS) OVER w AS status, last_value(p IGNORE NULLS) OVER w AS progress FROM c, mark WHERE ms <= now WINDOW w AS (PARTITION BY id ORDER BY ms, seq)""")
def x1_time(t):
    """Each job's state after every change, in the order of the changes' times."""
    k = F.col("event_id")
    own = t("events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), k.cast("long").alias("seq"), F.when(k % 2 == 0, F.col("event_type")).otherwise("").alias("status"), F.when(k % 3 == 0, F.floor("value").cast("int")).alias("progress"), F.lit("").alias("stage"))
    return drained(keyed.job_state_by_time(streamed(own, "changes")), "job-state-by-time").select("id", "ms", "seq", "status", "progress")


@query("x4_consent_of_two_streams", f"""WITH u AS (SELECT *, epoch_us(ts) // 1000 AS ms, event_id % 10 = 0 AS consent FROM events), mark AS (SELECT least(max(ms) FILTER (consent), max(ms) FILTER (NOT consent)) - 600000 AS now FROM u),
a AS (SELECT *, last_value(CASE WHEN consent THEN {{'ms': ms, 'granted': event_id % 20 = 0}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, NOT consent, event_id) AS last FROM u)
SELECT user_id::VARCHAR AS subject, ms, event_id AS seq FROM a, mark WHERE NOT consent AND ms <= now AND last.granted AND ms < last.ms + 864000000""")
def x4_two(t):
    """Events under a consent of the last ten days, consents and events being streams of their own."""
    k = F.col("event_id")
    own = t("events").select(F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), k.cast("long").alias("seq"))
    consents = own.where("seq % 10 = 0").withColumns({"version": F.lit("v1"), "state": F.when(F.col("seq") % 20 == 0, "granted").otherwise("denied")})
    gate = keyed.consented(streamed(consents, "consents"), streamed(own.where("seq % 10 <> 0"), "consent-events"), "v1", 10 * 86_400)
    return drained(gate, "consented").select("subject", "ms", "seq")


@query("x6_stream_progress", f"""WITH {FEED_SQL}, g AS (SELECT *, count(*) FILTER (type = 'result') OVER (PARTITION BY job_id ORDER BY seq) - (type = 'result')::INT AS part FROM feed)
SELECT job_id, seq, type, CASE WHEN type = 'result' THEN 100.0 ELSE least(100.0, greatest(0.0, max(progress) FILTER (type = 'progress') OVER (PARTITION BY job_id, part ORDER BY seq))) END::DOUBLE AS shown FROM g""")
def x6(t):
    return drained(states.stream_progress(streamed(_feed(t).drop("message"), "feed-rows")), "progress-shown").select("job_id", "seq", "type", "shown")


@query("x8_stream_usage_counts", "WITH c AS (SELECT date_trunc('hour', ts) AS h, event_type AS event, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(h) // 1000 AS start_ms, event, n FROM c WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def x8(t):
    own = t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
    return drained(states.stream_usage_counts(streamed(own, "usage")), "usage-counts").select(F.unix_millis("start").alias("start_ms"), "event", "n")


@query("f14_device_details", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'd' || user_id WHEN user_id % 3 = 1 THEN 'h' || user_id END AS device_id, CASE WHEN event_id % 2 = 0 THEN 'Linux' WHEN event_type = 'click' THEN 'macOS' END AS os,
 (user_id % 3 < 2)::INT + (event_id % 2 = 0 OR event_type = 'click')::INT AS n FROM events""")
def f14(t):
    user, k = F.col("user_id").cast("string"), F.col("user_id") % 3
    body = F.create_map(F.lit("deviceId"), F.when(k == 0, F.concat(F.lit(" d\u0001"), user)).otherwise(""), F.lit("os"), F.when(F.col("event_id") % 2 == 0, "GNU/Linux").otherwise(""))
    headers = F.create_map(F.lit("x-device-id"), F.when(k == 1, F.concat(F.lit("h"), user)).otherwise(" "), F.lit("user-agent"), F.when(F.col("event_type") == "click", "Mozilla/5.0 (Macintosh)").otherwise("curl"))
    own = t("events").select("event_id", s.device_details(body, headers).alias("d"))
    return own.select("event_id", F.try_element_at("d", F.lit("deviceId")).alias("device_id"), F.try_element_at("d", F.lit("os")).alias("os"), F.size("d").alias("n"))


@query("f17_crc32", """SELECT p_partkey, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)),
 lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)), 4294967295)::BIGINT AS crc FROM part""")
def f17(t):
    return t("part").select("p_partkey", F.crc32(F.encode("p_name", "utf-8")).alias("crc"))


@query("f24_is_pdf", "SELECT doc_id, doc_id % 3 = 0 OR starts_with(text, '%PDF-') AS pdf FROM documents")
def f24(t):
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 3 == 1, "%PDF 1.7").otherwise("")
    return t("documents").select("doc_id", s.is_pdf(F.encode(F.concat(head, "text"), "utf-8")).alias("pdf"))


@query("f6_format_bytes", """SELECT l_orderkey, l_linenumber, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN printf('%.1f KB', b / 1000.0) WHEN b < 1000000000 THEN printf('%.1f MB', b / 1000000.0) ELSE printf('%.1f GB', b / 1000000000.0) END AS size
FROM (SELECT l_orderkey, l_linenumber, (floor(l_quantity) * power(10, l_linenumber))::BIGINT + 7 AS b FROM lineitem)""")
def f6(t):
    b = (F.floor(F.col("l_quantity").cast("double")) * F.pow(F.lit(10.0), F.col("l_linenumber"))).cast("long") + 7
    return t("lineitem").select("l_orderkey", "l_linenumber", s.format_bytes(b).alias("size"))


@query("f27_pre_releases", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, (event_id % 2 = 0) DESC, CASE WHEN event_id % 2 = 1 THEN event_type END DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def f27_pre(t):
    """Each user's latest version; a release comes after its pre-releases, which go by name."""
    pre = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("-"), F.regexp_replace("event_type", "_", "."))).otherwise("")
    version = F.concat(F.lit("v1."), (F.col("event_id") % 3).cast("string"), pre)
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct(s.version_key(version), "event_id")).alias("event_id"))


@query("d6_spacing", r"""SELECT conv_id, turn, count(*) FILTER (NOT (regexp_matches(a, '^[₹$€£¥₽₩¢]$') OR regexp_matches(a, '^[₹$€£¥₽₩¢]\s*[-+]?\d') OR regexp_matches(b, '^[,.;:%!?)]'))) AS spaced, count(*) FILTER (regexp_matches(a, '^[₹$€£¥₽₩¢]$')) AS signs
FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS a, unnest(string_split(text, ' ')[2:]) AS b FROM conversations) WHERE a <> '' AND b <> '' GROUP BY ALL""")
def d6(t):
    parts = F.split("text", " ")
    pairs = t("conversations").select("conv_id", "turn", F.explode(F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("a"), F.slice(parts, 2, F.size(parts)).alias("b"))).alias("p")).select("conv_id", "turn", "p.a", "p.b").where("a <> '' and b <> ''")
    return pairs.groupBy("conv_id", "turn").agg(F.count_if(s.needs_space(F.col("a"), F.col("b"))).alias("spaced"), F.count_if(s.currency_like(F.col("a"))).alias("signs"))
