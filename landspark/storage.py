"""Where jobs keep tables that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several branches of a plan read is made once, and survives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_version(df: DataFrame, path: str, version: int) -> str:
    """Write a table's next version beside the others; readers of the old one are not disturbed."""
    where = f"{path}/v={version:08d}"
    df.write.mode("overwrite").parquet(where)
    return where


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Write several tables as one version: all of them, and then a manifest that names their folders; returns its number.

    A version exists when its manifest is complete, which is a single commit of one small file; what a failure leaves before that is
    named by no manifest.  Of two writers of one number the second one fails, before any reader has seen its tables.
    """
    spark = next(iter(tables.values())).sparkSession
    number, stamp = last_version(spark, root) + 1, uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        where = f"{root}/{name}/{number:08d}-{stamp}"
        df.write.parquet(where)
        rows.append((number, name, where))
    manifest = spark.createDataFrame(rows, "version long, name string, path string").coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest/{number:08d}")
    return number


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long, name string, path string").option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_version(spark: SparkSession, root: str) -> int:
    """The number of the newest complete version; zero without any."""
    found = _manifests(spark, root)
    return 0 if found is None else found.agg(F.max("version")).first()[0] or 0


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a complete version, the newest one if none is named; none without any."""
    version = last_version(spark, root) if version is None else version
    found = _manifests(spark, root) if version else None
    return {} if found is None else {r.name: spark.read.parquet(r.path) for r in found.filter(F.col("version") == version).collect()}
