"""Row numbers of split sheets, repeated jobs, picture files and batches that are taken once."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkveil.plans import batch
from inkveil.sources import tables
from inkveil.streaming import jobs


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    yield
    spark.conf.set(key, before)


def test_rows_are_counted_over_splits(spark, tmp_path, small_splits):
    for name, n in (("a b", 700), ("plus+", 3), ("~temp", 5), ("none", 0)):
        (tmp_path / f"{name}.csv").write_text("url,n\n" + "".join(f" http://h/{k} ,{k}\n" if k % 5 else f"ftp:{k},{k}\n" for k in range(n)))
    assert spark.read.option("header", True).csv(str(tmp_path)).rdd.getNumPartitions() > 3
    got = sorted((r.file, r.row_num, r.url) for r in tables.read_manifest(spark, str(tmp_path)).collect())
    assert got == sorted((f"{name}.csv", k + 2, f"http://h/{k}") for name, n in (("a b", 700), ("plus+", 3)) for k in range(n) if k % 5)


def test_repeated_jobs_write_keys_once(spark, tmp_path):
    path = str(tmp_path / "masked")
    schema = "key string, derived_key string, content binary, job string"
    one = spark.createDataFrame([("o1", "m1.png", b"1", "x"), ("o1", "m1.png", b"1", "x"), ("o2", "o2", b"2", "x"), ("o3", None, b"3", "x"), (None, "m4", None, "x")], schema)
    two = spark.createDataFrame([("o1", "m1.png", b"9", "x"), ("o5", "m5.jpg", b"5", "x")], schema)
    tables.append_masked(one, path, "one")
    (tmp_path / "masked" / "job=two").mkdir()  # a job that was broken off
    (tmp_path / "masked" / "job=two" / "part-0.parquet").write_bytes(b"half")
    want = {("m1.png", "image/png", b"1"), ("m4", "application/octet-stream", None)}
    shown = lambda: sorted(((r.key, r.content_type, r.content and bytes(r.content)) for r in tables.read_masked(spark, path).collect()), key=str)
    assert shown() == sorted(want, key=str)
    for _ in range(2):
        tables.append_masked(two, path, "two")
        tables.append_masked(one, path, "one")
        assert shown() == sorted(want | {("m5.jpg", "image/jpeg", b"5")}, key=str)


def test_no_jobs_yet(spark, tmp_path):
    assert tables.read_masked(spark, str(tmp_path)).count() == 0


def test_files_are_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", b"123"), ("a/y.bin", b""), (None, b"1"), ("z", None)], "name string, content binary")
    got = {r.name: r.bytes for r in tables.write_files(df, f"file://{tmp_path}").collect()}
    assert got == {"a/x.bin": 3, "a/y.bin": 0} and (tmp_path / "a" / "x.bin").read_bytes() == b"123"


def test_pictures_and_rejects(spark, tmp_path):
    (tmp_path / "bad 1+.png").write_bytes(b"no picture")
    good, bad = tables.read_pictures(spark, str(tmp_path), "*.png")
    assert good.count() == 0 and [(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()] == [("bad 1+.png", "not an image")]


def test_a_batch_is_taken_once(spark, tmp_path):
    path, write = str(tmp_path / "out"), jobs.once_by_batch(str(tmp_path / "out"))
    df = spark.range(3)
    assert jobs.finished_batches(spark, path, "id bigint").count() == 0
    write(df, 0)
    write(df, 0)  # replayed
    (tmp_path / "out" / "batch_id=1").mkdir()
    (tmp_path / "out" / "batch_id=1" / "part-0.parquet").write_bytes(b"broken off")
    assert jobs.finished_batches(spark, path, "id bigint").count() == 3
    write(df.where("id > 0"), 1)
    assert sorted(map(tuple, jobs.finished_batches(spark, path, "id bigint").collect())) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_sketches_add_up_over_days(spark):
    days = F.expr("date_add(DATE'2024-01-01', int(id % 7))").alias("day")
    metrics = spark.range(20_000).select(days, (F.col("id") * 7919 % 20_000).cast("double").alias("ocr_ms"), F.lit(None).cast("double").alias("mask_ms"))
    sketches = batch.latency_sketches(metrics, stages=("ocr_ms", "mask_ms"))
    assert sketches.count() == 7
    (row,) = batch.latency_of_days(sketches).collect()
    assert (row.stage, row.images, row.avg_ms, row.max_ms, row.share) == ("ocr_ms", 20_000, 9999.5, 19_999.0, 1.0)
    assert abs(row.p50_ms - 10_000) < 200 and abs(row.p95_ms - 19_000) < 200
    part = batch.latency_of_days(sketches.where(F.col("day") == datetime.date(2024, 1, 3))).first()
    assert part.images == 2857
    assert batch.latency_of_days(sketches.limit(0)).count() == 0
