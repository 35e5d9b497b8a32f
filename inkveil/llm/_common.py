"""Helpers shared by the text operators: table access, shared storage, batch bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.sources.staging import drop, fresh_path, shared_dir
from inkveil.sources.staging import staged as stored

__all__ = ["BATCH_ROWS", "Batches", "drop", "fresh_path", "id_and_text", "materialize", "partitions", "rows", "shared_dir", "stored", "table", "utf8"]

#: Rows of one Arrow batch of the given tables. Spark bounds a batch in bytes as well
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), also for callers that
#: bring tables of their own.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; Arrow batches of this session become bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text (null: empty) under fixed names, so that no
    other column of the input can clash with what an operator adds."""
    plain = id_col == "doc_id" and dict(docs.dtypes)[id_col] == "bigint"  # then no alias, which would keep Spark from sharing exchanges
    return docs.select("doc_id" if plain else F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep on shared storage, cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(name).type) else pa.binary()
    return batch.column(name).cast(kind).to_pylist()


def rows(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for t, v in columns.values()], names=list(columns))


Batches = Iterator[pa.RecordBatch]
