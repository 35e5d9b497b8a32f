"""Tables that several steps read, kept once on the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local-mode session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/inkveil-{what}-{uuid.uuid4().hex}"


GROUPS_OF_A_FILE = 128  # row groups of a file of wide rows


def staged(df: DataFrame, what: str, rows_at_once: int | None = None) -> DataFrame:
    """Computed once, as a Parquet table on the shared storage; the lineage is cut.

    rows_at_once: rows of a row group, for rows of many bytes that compress well. Readers decode up to
    4,096 rows of a row group at once, and its usual bound is one of compressed bytes. Until a file is
    done, its writer keeps each row group's least and greatest values whole, which here would be two
    rows of each 32 or so: so there are no statistics, and a file ends after GROUPS_OF_A_FILE row groups.
    """
    path = fresh_path(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    if rows_at_once:
        writer = writer.options(**{"parquet.block.row.count.limit": rows_at_once, "parquet.column.statistics.enabled": "false", "maxRecordsPerFile": rows_at_once * GROUPS_OF_A_FILE})
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_in_turns(parts: Iterable[DataFrame], what: str) -> DataFrame:
    """As staged(), of tables of one schema (at least one): each is made and written after the one before, so that the driver plans one at a time."""
    path = None
    for df in parts:
        path = path or fresh_path(df.sparkSession, what)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of any storage that Spark knows which match a pattern, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or ())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of fresh_path() that nothing reads any more."""
    if "/inkveil-" not in path:
        raise ValueError("not a folder of this library")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
