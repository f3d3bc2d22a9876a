"""File listings as frames: what is new, changed or gone, and what to upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import JOB_ID


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """LISTING of a glob on any file system; hidden names (``_``, ``.``) are left out by Spark."""
    rows = spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_path").alias("file_name"), "modificationTime", "length")
    return rows.select("file_name", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def existing(spark: SparkSession, globs: list[str]) -> list[str]:
    """Those of the globs that match something, on any file system."""
    out = []
    for glob in globs:
        at, files = file_system(spark, glob)
        if len(files.globStatus(at) or ()):
            out.append(glob)
    return out


def partitions(spark: SparkSession, path: str, keys: tuple[str, ...]) -> list[tuple[str | None, ...]]:
    """The values of the partition folders ``key=value/...`` under a path, in order; none if it is not there."""
    at, files = file_system(spark, "/".join([path, *(f"{k}=*" for k in keys)]))
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = []
    for status in files.globStatus(at) or ():
        names = status.getPath().toString().split("/")[-len(keys) :]
        values = [unescape(n.split("=", 1)[1]) for n in names]
        found.append(tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values))
    return sorted(found, key=str)


def remove(spark: SparkSession, path: str) -> None:
    at, files = file_system(spark, path)
    files.delete(at, True)


def total_bytes(listing: DataFrame) -> DataFrame:
    return listing.groupBy("file_name").agg(F.max("bytes").alias("bytes")).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_name, state): unprocessed, modified, processed or deleted; times are compared by the second."""
    new, old = listing.select("file_name", F.col("modified").alias("now")), manifest.select("file_name", F.col("modified").alias("then"))
    second = [F.date_trunc("second", c) for c in ("now", "then")]
    state = F.when(F.col("then").isNull(), "unprocessed").when(F.col("now").isNull(), "deleted").when(second[0] != second[1], "modified").otherwise("processed")
    return new.join(old, "file_name", "full").select("file_name", state.alias("state"))


def job_token(name: str | Column) -> Column:
    return F.nullif(F.regexp_extract(name, JOB_ID, 0), F.lit(""))


def to_upload(logs: DataFrame, confs: DataFrame, uploaded: DataFrame, grid: str, now_ms: int, days: int, dest: str = "") -> DataFrame:
    """(file_name, conf_name, target): logs last changed in [now - days, now - 24 h) with a conf, whose target is not there yet.

    logs: (file_name, modified_ms); confs: (file_name, queue); uploaded: (target).
    """
    day = 86_400_000
    name = F.element_at(F.split("file_name", "/"), -1)
    fit = logs.filter(F.col("modified_ms").between(now_ms - days * day, now_ms - day - 1) & ~name.rlike(r"^[._]|\.xml$|\.crc$"))
    left = fit.withColumn("token", job_token(name)).filter("token is not null")
    right = confs.select(F.col("file_name").alias("conf_name"), F.coalesce("queue", F.lit("unknown")).alias("queue"), job_token("file_name").alias("token"))
    stamp = F.timestamp_millis("modified_ms")
    target = F.concat_ws("/", F.lit(f"{dest}{grid}"), F.lit("daily"), "queue", F.date_format(stamp, "yyyy"), F.date_format(stamp, "MMdd"), name)
    return left.join(right, "token").withColumn("target", target).select("file_name", "conf_name", "target").join(uploaded, "target", "left_anti").select("file_name", "conf_name", "target")
