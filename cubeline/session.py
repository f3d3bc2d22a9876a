"""Session settings, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: What the plans of this package rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM does not compile larger methods; Spark then runs the parts of a plan as smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that exists."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="cubeline-ship-"), "cubeline.zip")  # the driver serves it
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where the driver and all executors can write: the session's ``spark.checkpoint.dir``, or a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cubeline-"))


def build(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings; conf: more of them, with underscores for dots."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
