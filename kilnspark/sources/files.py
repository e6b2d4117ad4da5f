"""Sources and sinks: jobs, projects, media files, progress feeds, audit rows, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions.scalars import escape_xml

JOB_SCHEMA = (
    "id STRING, tool STRING, status STRING, source_path STRING, source_name STRING, reference_path STRING, reference_name STRING, options STRING, progress INT, stage STRING, "
    "message STRING, warnings STRING, logs STRING, conversion_progress INT, conversion_current STRING, conversion_total STRING, result STRING, error STRING, created_at BIGINT, updated_at BIGINT"
)
PROGRESS_SCHEMA = "type STRING, job_id STRING, seq BIGINT, progress DOUBLE, message STRING"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_SCHEMA).parquet(path)


def read_projects(spark: SparkSession, folder: str, name: str = "project.json") -> DataFrame:
    """(project_id, doc variant, updated_at): the JSON file of each project folder with a safe name; unreadable ones are left out.

    name may hold wildcards; a folder may be written as a partition, key=id.
    """
    raw = spark.read.option("basePath", folder).option("recursiveFileLookup", "false").text(f"{folder}/*/{name}", wholetext=True)
    raw = raw.select("value", F.regexp_extract(F.input_file_name(), "/(?:[A-Za-z0-9_]+=)?([^/=]+)/[^/]+$", 1).alias("project_id"))
    docs = raw.where(F.col("project_id").rlike("^[A-Za-z0-9_-]{1,64}$")).withColumn("doc", F.try_parse_json("value")).where("doc is not null")
    return docs.select("project_id", "doc", F.try_variant_get("doc", "$.updatedAt", "string").alias("updated_at"))


def projects_by_update(projects: DataFrame) -> DataFrame:
    """Projects(project_id, updated_at), newest first by text, those without a time last, then by id."""
    return projects.orderBy(F.desc_nulls_last("updated_at"), "project_id")


def write_projects(projects: DataFrame, path: str) -> None:
    """projects(project_id, json) as one partition each; only theirs are replaced."""
    stamped = projects.withColumn("written_at", F.current_timestamp())
    stamped.write.partitionBy("project_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def delete_project(projects: DataFrame, project_id: str) -> DataFrame:
    """The projects without one; a missing one is an error."""
    if projects.where(F.col("project_id") == project_id).isEmpty():
        raise LookupError(f"no project {project_id}")
    return projects.where(F.col("project_id") != project_id)


def export_project(records: DataFrame) -> DataFrame:
    """(project_id, collection, ord, json) from records(project_id, collection, ord, doc variant): a line for each record, so that a project of any size can be written, by project."""
    return records.select("project_id", "collection", "ord", F.to_json("doc").alias("json"))


def import_project(exported: DataFrame) -> DataFrame:
    """Records(project_id, collection, ord, doc) back from export_project()'s rows; lines that are no JSON are left out."""
    return exported.select("project_id", "collection", "ord", F.try_parse_json("json").alias("doc")).where("doc is not null")


def read_media(spark: SparkSession, folder: str, pattern: str = "*", most: int | None = None, content: bool = False) -> DataFrame:
    """(path, size, modified[, content]) of the files below a folder; beyond `most` files is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if most is not None and out.count() > most:
        raise ValueError(f"more than {most} files")
    return out


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of progress, result and error rows from JSON lines."""
    return spark.readStream.schema(PROGRESS_SCHEMA).json(folder)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_sitemap(routes: DataFrame, path: str) -> None:
    """routes(loc, lastmod) as url elements, one text file a partition; no lastmod element without a date."""
    sitemap_entries(routes).write.mode("overwrite").text(path)


def sitemap_entries(routes: DataFrame) -> DataFrame:
    date = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod>"))).otherwise("")
    return routes.select(F.concat(F.lit("<url><loc>"), escape_xml(F.col("loc")), F.lit("</loc>"), date, F.lit("</url>")).alias("entry"))
