"""Job configuration documents: XML property lists to maps, a document a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import JOB_ID, located

_SCHEMA = "property array<struct<name:string,value:string>>"


def configuration(xml: Column) -> Column:
    """name -> value; of equal names the last; null if the document cannot be read."""
    listed = F.from_xml(xml, _SCHEMA, {"rowTag": "configuration", "ignoreSurroundingSpaces": "false"})["property"]
    named = F.filter(listed, lambda p: p["name"].isNotNull())
    return F.map_from_entries(F.transform(named, lambda p: F.struct(p["name"], F.coalesce(p["value"], F.lit("")))))


def read_confs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, cluster, day, job_id, configuration)."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_confs(located(rows))


def parse_confs(documents: DataFrame) -> DataFrame:
    """documents: (path, value, ...); the job id is in the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    job = F.nullif(F.regexp_extract(name, JOB_ID, 0), F.lit(""))
    return documents.withColumns({"job_id": job, "configuration": configuration(F.col("value"))}).drop("value", "queue")


def accepted(confs: DataFrame) -> DataFrame:
    return confs.filter("job_id is not null and configuration is not null")


def rejected(confs: DataFrame) -> DataFrame:
    return confs.filter("job_id is null or configuration is null").select("path", F.when(F.col("job_id").isNull(), "no_job_id").otherwise("malformed").alias("reason"))


def queue(conf: Column) -> Column:
    return F.coalesce(F.try_element_at(conf, F.lit("mapred.job.queue.name")), F.lit("unknown"))


def join_confs(jobs: DataFrame, confs: DataFrame) -> DataFrame:
    return jobs.join(confs.select("cluster", "job_id", "configuration"), ["cluster", "job_id"], "left")
