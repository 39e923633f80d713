"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

#: Root of the provided tables; a parameter of everything that needs it.
DEFAULT_DATA = "/root/testdata"


def get_spark(app: str = "tallylog", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where the setting is missing and all runs on one machine (tests) a temporary
    folder is made and set for the session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallylog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Owns the folders of intermediate tables made while it is entered, and removes them when it is left.

    Results of queries are lazy and read these tables: take them (collect, write)
    before the end. Without an owner the tables stay until the shared folder goes.
    """

    _entered: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._entered.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._entered.remove(self)
        for path in self.paths:
            remove_dir(self.spark, path)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other run uses; it belongs to the Scratch entered last, if any."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if Scratch._entered:
        Scratch._entered[-1].paths.append(path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a path made by fresh_dir, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def materialized(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there.

    Used where a result is read several times and must be the same each time,
    also after an executor is lost.
    """
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions set for the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session.

    Workers import functions by module name; this makes that work on any
    cluster, without an installation on each machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tallylog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    folder = tempfile.mkdtemp(prefix="tallylog-code-")
    name = os.path.join(folder, "tallylog_code.zip")
    Path(name).write_bytes(blob.getvalue())
    sc.addPyFile(name)
    sc._tallylog_shipped = True
