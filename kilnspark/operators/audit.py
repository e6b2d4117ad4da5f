"""Audits: activity by device, HTML pages, route policies, repeated paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.scalars import SPACE, trimmed


def audit_by_device(items: DataFrame, search: str = "", os: str = "", sort: str = "recent") -> DataFrame:
    """Items(id, device_id, device_name, os, origin, details, created_at) grouped by device.

    The key is the device id, else its name, else system and origin. Per device:
    count, latest time, item ids newest first (of equal times the larger id).
    search looks in label, origin and details; sort: recent, oldest, count, label.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    device, name, system, origin = blank("device_id"), blank("device_name"), F.coalesce(blank("os"), F.lit("Unknown")), F.coalesce(blank("origin"), F.lit("unknown"))
    key = F.when(device.isNotNull(), F.concat(F.lit("id:"), device)).when(name.isNotNull(), F.concat(F.lit("name:"), name)).otherwise(F.concat(F.lit("os:"), system, F.lit(":"), origin))
    label = F.coalesce(name, F.concat(F.lit("Device "), F.substring(device, 1, 8)), F.when(system != "Unknown", F.concat(system, F.lit(" device"))), F.lit("Unknown device"))
    rows = items.select(key.alias("key"), label.alias("label"), system.alias("system"), origin.alias("origin"), F.coalesce(F.col("details").cast("string"), F.lit("")).alias("details"), "id", "created_at")
    if search:
        rows = rows.where(F.lower(F.concat_ws(" ", "label", "origin", "details")).contains(search.lower()))
    if os:
        rows = rows.where(F.col("system") == os)
    newest = F.struct("created_at", "id")
    out = rows.groupBy("key").agg(F.max_by("label", newest).alias("label"), F.count("*").alias("n_items"), F.max("created_at").alias("latest"), F.reverse(F.array_sort(F.collect_list(newest)))["id"].alias("items"))
    order = {"recent": F.desc("latest"), "oldest": F.asc("latest"), "count": F.desc("n_items"), "label": F.asc("label")}[sort]
    return out.orderBy(order, "key")


def audit_tail(items: DataFrame, limit: object = None) -> DataFrame:
    """The newest items; limit 200 unless 1 to 500 is asked for. Details other than an object become {}."""
    try:
        n = int(str(limit)) or 200
    except ValueError:
        n = 200
    shape = F.schema_of_variant(F.try_parse_json("details"))
    own = items.withColumn("details", F.when(F.startswith(shape, F.lit("OBJECT")), F.col("details")).otherwise("{}"))
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(500, n)))


def meta_content(html: Column, name: str) -> Column:
    return F.regexp_extract(html, f"(?i)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)


def visible_length(html: Column) -> Column:
    """Characters left when tags become spaces and spaces collapse."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), SPACE + "+", " ")))


def extract_meta(pages: DataFrame) -> DataFrame:
    """pages(html) with title, description, robots, canonical and h1."""
    html = F.coalesce(F.col("html"), F.lit(""))
    h1 = F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")
    return pages.withColumns({
        "title": F.trim(F.regexp_extract(html, "(?i)<title[^>]*>([^<]*)</title>", 1)),
        "description": meta_content(html, "description"),
        "robots": meta_content(html, "robots"),
        "canonical": F.regexp_extract(html, "(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']*)[\"']", 1),
        "h1": F.trim(F.regexp_replace(h1, SPACE + "+", " ")),
    })


def page_audit(pages: DataFrame, policy: DataFrame, script: str, thin: int = 600) -> DataFrame:
    """Each page(page_id, url, html) with the array of reasons against it, under policy(path, indexable)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    copies = (F.length(html) - F.length(F.replace(html, F.lit(script), F.lit("")))) / max(1, len(script))
    seen = route_policy(extract_meta(pages), policy).withColumn("copies", copies.cast("int"))
    listed = F.coalesce(F.col("indexable"), F.lit(True))
    rules = [
        (F.col("title") == "", "no title"), (F.col("description") == "", "no description"), (F.col("h1") == "", "no h1"),
        (listed & F.col("robots").rlike("(?i)noindex"), "robots"), (F.col("canonical") != F.col("url"), "canonical"),
        (F.col("copies") != F.when(listed, 1).otherwise(0), "script copies"), (visible_length(html) <= thin, "thin"),
    ]
    return seen.select("page_id", "title", "h1", "copies", F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules])).alias("reasons"))


def route_path(url: Column) -> Column:
    """A URL's path without query, fragment and trailing slash; / for the root."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", ""), "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def route_policy(urls: DataFrame, policy: DataFrame, prefix: str = "/downloads/") -> DataFrame:
    """urls(url) with the policy(path, indexable) of their route; paths under the prefix share one."""
    path = route_path(F.col("url"))
    keyed = urls.withColumn("path", F.when(F.startswith(path, F.lit(prefix)), F.lit(prefix)).otherwise(path))
    return keyed.join(policy.select("path", "indexable").hint("merge"), "path", "left")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the values that stand in more than one row; null and blank ones don't count."""
    return df.where(F.trim(F.col(column)) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def repeated_paragraphs(docs: DataFrame, least: int = 120, split: str = "\n") -> DataFrame:
    """(paragraph, n_docs) of paragraphs of `least` characters or more in several documents(doc_id, text)."""
    lines = docs.select("doc_id", F.explode(F.transform(F.split("text", split), trimmed)).alias("paragraph")).where(F.length("paragraph") >= least)
    return lines.groupBy("paragraph").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs > 1")


def parse_sitemap(files: DataFrame) -> DataFrame:
    """(ord, path, lastmod) of each url element of files(xml)."""
    entries = files.select(F.posexplode(F.regexp_extract_all("xml", F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("ord", "entry"))
    return entries.select("ord", route_path(F.regexp_extract("entry", "<loc>\\s*(.*?)\\s*</loc>", 1)).alias("path"), F.nullif(F.regexp_extract("entry", "<lastmod>(.*?)</lastmod>", 1), F.lit("")).alias("lastmod"))


def sitemap_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): listed(ord, path, lastmod) against the policy: missing, extra, moved or another date."""
    a = actual.select("path", F.col("ord").alias("a_ord"), F.col("lastmod").alias("a_lastmod"))
    e = expected.select("path", F.col("ord").alias("e_ord"), F.col("lastmod").alias("e_lastmod"))
    problem = F.when(F.col("a_ord").isNull(), "missing").when(F.col("e_ord").isNull(), "extra").when(F.col("a_ord") != F.col("e_ord"), "moved").when(~F.col("a_lastmod").eqNullSafe(F.col("e_lastmod")), "lastmod")
    return a.join(e, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def sets_that_overlap(routes: DataFrame) -> DataFrame:
    """(path, n_sets) of routes(path, set) that stand in more than one set."""
    return routes.groupBy("path").agg(F.countDistinct("set").alias("n_sets")).where("n_sets > 1")


def description_fits(text: Column, least: int = 120, most: int = 320) -> Column:
    """Whether a page's description is of a length that search results show."""
    return F.length(text).between(least, most)
