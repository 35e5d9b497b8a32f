"""What grows with the tables is spread over tasks and leaves them in bounded batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil import fixtures as X
from inkveil.operators import images, signatures
from tests.test_pixels import KIND, slow_cover


def test_pictures_are_drawn_by_several_tasks(spark):
    """The ids come from one small file, their pixels must not stay in its one task."""
    found = X.pictures(spark, "/root/testdata/sf0.001")
    assert found.groupBy(F.spark_partition_id()).count().count() > 4
    for r in found.limit(20).collect():
        n = r.image.height * r.image.width * 3
        assert bytes(r.image.data) == bytes((r.image_id * 7 + i * 13 + i // 5 * 31) % 256 for i in range(n))


def test_parts_are_bounded():
    sizes = np.array([3, 3, 9, 1, 1, 1, 20, 2])
    parts = X.parts_of(sizes, 6)
    assert np.concatenate([np.arange(8)[p] for p in parts]).tolist() == list(range(8))
    assert all(sizes[p].sum() <= 6 or p.stop - p.start == 1 for p in parts) and X.parts_of(sizes[:0]) == []


def test_scans_leave_a_task_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "DRAWN_BYTES", 1 << 20)
    sizes = X.scans(spark, "/root/testdata/sf0.001").selectExpr("image_id", "length(image.data) = image.width * image.height AS whole")
    assert sizes.where("whole").count() == sizes.count() == 150


def test_small_tables_of_large_images_are_not_broadcast(spark, tmp_path, capsys):
    """White scans take few bytes as files: a size check would broadcast all their pixels."""
    path = str(tmp_path / "scans")
    spark.createDataFrame([(k, ("", 50, 50, 1, 0, bytearray(b"\xff" * 2500))) for k in range(9)], KIND).write.parquet(path)
    scans = spark.read.parquet(path)
    areas = spark.range(100_000).select(F.col("id").alias("image_id"), F.lit(0).alias("area_id"), *[F.lit(v).alias(c) for c, v in (("ax1", 0), ("ay1", 0), ("ax2", 9), ("ay2", 9))])
    asked = spark.range(100_000).select(F.col("id").alias("request_id"), F.col("id").alias("image_id"), F.lit("black").alias("mask_mode"))
    none = spark.createDataFrame([], "image_id bigint, seq bigint, polygon array<array<int>>")
    for df in (signatures.ink_runs(scans, areas), images.mask_requests(scans, none, asked)):
        df.explain()
        plan = capsys.readouterr().out
        assert "ShuffledHashJoin" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("at_once", [1, 7, 200_000])
def test_strokes_of_many_images_at_once(spark, at_once, monkeypatch):
    """Images and areas of one batch don't touch each other; each has what it has alone, and no worker is called for each image."""
    monkeypatch.setattr(signatures, "RUNS_AT_ONCE", at_once)
    rng = np.random.default_rng(at_once)
    rows, want = [], []
    for image in range(12):
        for area in (0, 10**15 + image):
            ink = rng.random((9, 14)) < 0.35
            for y, x in zip(*np.nonzero(np.diff(np.pad(ink, ((0, 0), (1, 0))).astype(int), axis=1) == 1), strict=True):
                rows.append((image, area, int(y), int(x), int(x + np.argmin(np.append(ink[y, x:], False)))))
            left = ink.copy()
            while left.any():
                todo, cells = [tuple(np.argwhere(left)[0])], []
                left[todo[0]] = False
                while todo:
                    y, x = todo.pop()
                    cells.append((y, x))
                    for b, a in ((b, a) for b in range(max(y - 1, 0), min(y + 2, 9)) for a in range(max(x - 1, 0), min(x + 2, 14))):
                        if left[b, a]:
                            left[b, a] = False
                            todo.append((b, a))
                ys, xs = np.array(cells).T.tolist()
                want.append((image, area, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    runs = spark.createDataFrame(rows, "image_id bigint, area_id bigint, y int, x1 int, x2 int")
    found = signatures.stroke_components(runs)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()


def test_boxes_are_painted_as_polygons_are():
    rng = np.random.default_rng(11)
    for _ in range(60):
        (a, b), (c, d) = rng.integers(-5, 20, (2, 2))
        h, w = rng.integers(1, 16, 2)
        for points in ([[a, b], [c, b], [c, d], [a, d]], [[a, b], [a, d], [c, d], [c, b]]):
            assert images.is_box(np.array(points))
            image = rng.integers(1, 255, (h, w, 3), np.uint8)
            got = images.paint(image, [points], images.MODES["black"])
            assert ((got == 0).all(axis=2) == slow_cover(np.array(points), h, w)).all()
    assert not images.is_box(np.array([[0, 0], [4, 1], [4, 5], [0, 5]]))


def test_wide_rows_are_staged_in_small_row_groups(spark):
    """4,096 white scans in one row group would be decoded at once."""
    import glob

    import pyarrow.parquet as pq

    from inkveil.sources.staging import staged

    white = spark.range(0, 200, 1, 1).select("id", F.expr("cast(repeat('w', 10000) as binary)").alias("data"))
    done = staged(white, "wide", rows_at_once=32)
    folder = done.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    meta = pq.ParquetFile(glob.glob(f"{folder}/*.parquet")[0]).metadata
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 32 and done.count() == 200


def test_a_writer_of_wide_rows_forgets_them(spark):
    """Statistics of each row group held two whole scans of it in the writer, as long as its file was open."""
    import pyarrow.parquet as pq

    from inkveil.sources import staging

    done = staging.staged(spark.range(0, 5 * staging.GROUPS_OF_A_FILE, 1, 1).select("id", F.expr("cast(repeat('w', 100) as binary)").alias("data")), "wide", rows_at_once=2)
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in done.inputFiles()]
    assert sorted(m.num_rows for m in metas) == [staging.GROUPS_OF_A_FILE, 2 * staging.GROUPS_OF_A_FILE, 2 * staging.GROUPS_OF_A_FILE]
    stats = [m.row_group(k).column(c).statistics for m in metas for k in range(m.num_row_groups) for c in (0, 1)]
    assert not any(s is not None and s.has_min_max for s in stats) and done.distinct().count() == 5 * staging.GROUPS_OF_A_FILE


def test_exact_percentiles_equal_sparks(spark):
    """Percentiles by ranks of ranges: values of one stage never meet in one group."""
    from inkveil.plans import batch

    rows = spark.range(3000).selectExpr(
        "CAST(id % 7 AS DOUBLE) AS orientation_ms", "CAST(hash(id) % 1000 AS DOUBLE) / 8 AS ocr_ms", "CASE WHEN id = 5 THEN 2.5D WHEN id = 6 THEN 4D END AS rotation_retry_ms",
        "CAST(NULL AS DOUBLE) AS detect_ms", "CASE WHEN id % 3 = 0 THEN double('NaN') ELSE CAST(-id AS DOUBLE) END AS mask_ms")
    found = batch.stage_latency(rows, exact=True)
    stack = ", ".join(f"'{s}', {s}" for s in batch.STAGES)
    want = rows.selectExpr(f"stack(5, {stack}) AS (stage, ms)").where("ms IS NOT NULL").groupBy("stage").agg(F.count("*"), F.percentile("ms", 0.5), F.percentile("ms", 0.95), F.max("ms"))
    assert sorted(map(str, (tuple(r) for r in found.select("stage", "images", "p50_ms", "p95_ms", "max_ms").collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert "percentile(" not in found._jdf.queryExecution().toString()
    assert batch.stage_latency(rows.limit(0), exact=True).count() == 0


def test_a_replayed_stream_has_a_file_for_each_core(spark, monkeypatch):
    """Two files a batch were all that a stream's tasks could share."""
    import glob

    from inkveil import queries

    paths, fresh = {}, queries.fresh_path
    monkeypatch.setattr(queries, "fresh_path", lambda s, what: paths.setdefault(what, fresh(s, what)))
    queries.queries()["r1_stream_replay"](spark, "/root/testdata/sf0.001")
    cores = spark.sparkContext.defaultParallelism
    assert len(glob.glob(f"{paths['lines'].removeprefix('file:')}/*.parquet")) >= 3 * cores - 1
    assert len(glob.glob(f"{paths['regions'].removeprefix('file:')}/batch_id=*/_SUCCESS")) == 3


def test_picture_files_are_read_once_by_few_tasks(spark):
    from inkveil import queries

    tracker, cost = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.sparkContext.setJobGroup("files", "files")
    try:
        found = queries.queries()["s2_read_images"](spark, "/root/testdata/sf0.01")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 20  # of 2,000 files; 32 to a task would make 50 and more, for each of two readings
    assert found.where("error IS NOT NULL AND image_id % 9 = 0").count() == found.where("image_id % 9 = 0").count() > 200
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_the_driver_lists_few_files_at_a_time(spark, monkeypatch):
    """The driver's list of all files grew with them; folders are read in turns now."""
    from inkveil import queries
    from inkveil.sources import tables

    listed, read = [], tables.read_images
    monkeypatch.setattr(tables, "FILES_AT_ONCE", 500, raising=False)
    monkeypatch.setattr(tables, "read_images", lambda *a, **k: (df := read(*a, **k), listed.append(len(df.inputFiles())))[0])
    found = queries.queries()["s2_read_images"](spark, "/root/testdata/sf0.01")
    assert max(listed) <= 650 and sum(listed) == 2000 and len(listed) == 4
    assert found.count() == found.select("image_id").distinct().count() == 2000 - sum(k % 11 == 0 and k % 9 > 0 for k in range(2000))
