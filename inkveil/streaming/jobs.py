"""The detectors over streams of lines, outcomes of requests by window, and a sink that takes each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.rules import FORMATS, RULES, Rule, rule_regions
from inkveil.sources.staging import hadoop_files


def stream_detect(text_lines: DataFrame, rules: tuple[Rule, ...] = RULES + FORMATS) -> DataFrame:
    """Rule and format regions of lines as they arrive: stateless, so it appends; works on batches alike."""
    return rule_regions(text_lines, rules)


def request_outcomes(request_log: DataFrame, window: str = "10 minutes", watermark: str = "1 minute") -> DataFrame:
    """endpoint, window_start, window_end, n_ok, n_error, avg_ms per tumbling window; rows behind the watermark are dropped.

    On a stream in append mode a window comes out once, when the watermark has passed its end. Times
    without a zone stay so.
    """
    kind = dict(request_log.dtypes)["ts"]
    # watermarks need times with a zone
    timed = request_log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if request_log.isStreaming else request_log
    out = timed.groupBy(F.window("ts", window).alias("w"), "endpoint").agg(
        F.count_if(F.col("status") != "error").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.avg("elapsed_ms").alias("avg_ms")
    )
    return out.select("endpoint", F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), "n_ok", "n_error", "avg_ms")


def once_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch to a folder of its own, exactly once.

    A batch is there when its folder has the writer's mark of success. A batch that is replayed
    after that is left as it is; one that was broken off is written anew. No step needs a
    rename, so any storage will do.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        if not hadoop_files(batch.sparkSession, f"{folder}/_SUCCESS"):
            batch.write.mode("overwrite").option("compression", "zstd").parquet(folder)

    return write


def finished_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches of once_by_batch() that are there, with batch_id; those being written are left out."""
    done = [f.removesuffix("/_SUCCESS") for f in hadoop_files(spark, f"{path}/batch_id=*/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    return spark.read.schema(f"{schema}, batch_id bigint").option("basePath", path).parquet(*done)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, from where the checkpoint stands, into the batches under `path`."""
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once_by_batch(path)).start().awaitTermination()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """The checkpoint as after a crash between a batch's output and its commit: the last batch will run again."""
    last = max(hadoop_files(spark, f"{checkpoint}/commits/*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
