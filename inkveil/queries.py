"""Registered queries: each applies one operator to tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import fixtures as X
from inkveil.functions import lines as L
from inkveil.functions import requests as Q
from inkveil.functions import urls as U
from inkveil.functions.geometry import box_columns, iou, rect, value_polygon, value_position
from inkveil.operators import lines as OL
from inkveil.operators import images, locate, regions, rules, signatures, spatial
from inkveil.plans import batch, detect
from inkveil.sources import tables
from inkveil.sources.staging import fresh_path, staged
from inkveil.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def flat(polygon: Column) -> Column:
    """Coordinates of a polygon, comma-joined."""
    return F.array_join(F.transform(F.flatten(polygon), lambda c: c.cast("string")), ",")


def flat_regions(df: DataFrame, *more: str) -> DataFrame:
    return df.select("image_id", "source", "seq", "text", "category", flat(F.col("polygon")).alias("polygon"), "ocr_line_index", *more)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.derived(spark, sf_dir, X.IMAGE_META)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.derived(spark, sf_dir, X.REQUESTS)


def box_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of two detectors for each order line."""
    lines = staged(X.text_lines(spark, sf_dir), "lines")
    return regions.union_regions(rules.all_rule_regions(lines), lines.select(*rules.region_columns("llm", F.col("line_index"), F.col("text"), F.lit("name"), F.col("bbox"), F.col("line_index")))).drop("source_ord")


@query
def s1_manifest(spark, sf_dir):
    return tables.keep_http(X.derived(spark, sf_dir, X.MANIFEST)).select("file", "row_num", "url", "image_id")


@query
def p1_parse_object_url(spark, sf_dir):
    return U.parse_object_url(requests(spark, sf_dir), domain_map=spark.sql(X.DOMAIN_MAP)).select("request_id", "bucket", "region", "key", "url_error")


@query
def p2_build_object_url(spark, sf_dir):
    known = U.parse_object_url(requests(spark, sf_dir), domain_map=spark.sql(X.DOMAIN_MAP)).where("url_error IS NULL")
    return U.build_object_url(known, spark.sql(X.DOMAIN_MAP)).select("request_id", "object_url")


@query
def p3_derive_key(spark, sf_dir):
    known = U.parse_object_url(requests(spark, sf_dir)).where("url_error IS NULL")
    masked = U.derive_key(known, "masked", F.col("request_id") + 1_700_000_000).withColumnRenamed("derived_key", "masked_key")
    backup = U.derive_key(masked, "backup", 1_700_000_000).withColumnRenamed("derived_key", "backup_key")
    return U.derive_key(backup, "local").select("request_id", "masked_key", "backup_key", F.col("derived_key").alias("local_key"))


@query
def p4_supported_ext(spark, sf_dir):
    return U.filter_supported_ext(requests(spark, sf_dir)).select("request_id", "ext", "ext_ok")


@query
def p5_sniff_format(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(h) for h in ("FFD8FFE000", "89504E470D0A1A0A0000", "424D11", "52494646AA", "49492A00", "4D4D002A", "00", "4142434445464748494A", "")]), (F.col("request_id") % 9 + 1).cast("int"))
    return U.sniff_format(requests(spark, sf_dir).withColumn("content", F.unhex(head))).select("request_id", "format", "format_error")


@query
def p5_sniff_files(spark, sf_dir):
    """The kind of real contents: bitmaps, cut off and empty ones among them, and web pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page "), "page_id").alias("name"), F.encode("html", "utf-8").alias("content"))
    return U.sniff_format(X.picture_files(spark, sf_dir).unionByName(pages)).select("name", "format", "format_error")


@query
def p6_media_type(spark, sf_dir):
    out = U.suffix_or_default(U.media_type(requests(spark, sf_dir), "url").withColumn("ct", F.when(F.col("request_id") % 2 == 0, "image/PNG; charset=x")), "url", "ct")
    return out.select("request_id", "media_type", "suffix")


@query
def p7_request_defaults(spark, sf_dir):
    out = Q.apply_request_defaults(requests(spark, sf_dir).withColumn("categories", F.when(F.col("request_id") % 2 == 0, F.array(F.lit("date")))), "main")
    return out.select("request_id", "llm_provider", "mask_mode", F.array_join("categories", ",").alias("categories"))


@query
def p8_mask_mode(spark, sf_dir):
    return Q.validate_mask_mode(requests(spark, sf_dir)).select("request_id", "mask_mode", "mode_ok")


@query
def p9_error_class(spark, sf_dir):
    return Q.classify_errors(requests(spark, sf_dir)).select("request_id", "outcome")


@query
def p10_normalize_ocr(spark, sf_dir):
    found = X.derived(spark, sf_dir, X.BOXED_LINES)
    half = lambda c: F.col(c) + F.lit(0.5)
    poly = F.array(F.array(half("x1"), half("y1")), F.array(half("x2"), half("y1")), F.array(half("x2"), half("y2")), F.array(half("x1"), half("y2")))
    line = F.struct("line_index", F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(F.col("text")).alias("t"), F.when(F.col("o_orderkey") % 5 == 0, F.slice(poly, 1, 3)).otherwise(poly).alias("p"), "confidence")
    raw = found.groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("a"))
    pick = lambda k: F.transform("a", lambda x: x[k])
    raw = raw.select("image_id", pick("t").alias("rec_texts"), pick("p").alias("dt_polys"), F.slice(pick("confidence"), F.lit(1), F.size("a") - 1).alias("rec_scores"))
    return L.normalize_ocr(raw).select("image_id", "line_index", "text", flat(F.col("bbox")).alias("polygon"), "confidence")


@query
def p11_rescale_bbox(spark, sf_dir):
    return L.rescale_bbox(X.text_lines(spark, sf_dir), meta(spark, sf_dir)).select("image_id", "line_index", flat(F.col("bbox")).alias("polygon"))


@query
def p12_line_boxes(spark, sf_dir):
    return L.line_boxes(X.text_lines(spark, sf_dir)).select("image_id", "line_index", "x1", "y1", "x2", "y2")


@query
def p13_vision_size(spark, sf_dir):
    return L.plan_vision_image(meta(spark, sf_dir)).select("image_id", "sent_width", "sent_height")


@query
def p14_exif_angle(spark, sf_dir):
    return L.exif_angle(meta(spark, sf_dir)).select("image_id", "angle")


@query
def p15_face_regions(spark, sf_dir):
    faces = L.filter_faces(X.derived(spark, sf_dir, X.FACES), meta(spark, sf_dir))
    return L.face_regions(faces).select("image_id", flat(F.col("polygon")).alias("polygon"), "category")


@query
def j1_locate_items(spark, sf_dir):
    return locate.locate_llm_items(X.derived(spark, sf_dir, X.ITEMS), X.text_lines(spark, sf_dir)).select("image_id", "item_seq", "matched", "prefix_miss", "found_line")


@query
def j4_signature_boxes(spark, sf_dir):
    items = meta(spark, sf_dir).select("image_id", F.lit(0).alias("item_seq"), F.lit(True).alias("signature"), F.array(*[(F.col("image_id") * k % m).cast("double") for k, m in ((3, 70), (7, 90), (5, 130), (11, 97))]).alias("bbox_pct"))
    return locate.pct_boxes(items, meta(spark, sf_dir))


@query
def j5_empty_labels(spark, sf_dir):
    lines = X.derived(spark, sf_dir, X.BOXED_LINES)
    # every third image has print right of each line
    aside = lines.where("image_id % 3 = 0").select("image_id", (F.col("line_index") + 1000).alias("line_index"), F.lit("印刷").alias("text"), rect(F.col("x2") + 2, F.col("y1"), F.col("x2") + 8, F.col("y2")).alias("bbox"), "confidence")
    return flat_regions(rules.empty_label_regions(X.text_lines(spark, sf_dir).unionByName(aside)))


@query
def j6_search_areas(spark, sf_dir):
    lines = X.text_lines(spark, sf_dir)
    return spatial.near_doctor_search_areas(rules.rule_regions(lines), lines, meta(spark, sf_dir)).select("image_id", "seq", "ax1", "ay1", "ax2", "ay2")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tables.keep_http(X.derived(spark, sf_dir, X.MANIFEST))
    errors = manifest.where("image_id % 10 = 9").select("image_id", F.lit("download failed").alias("error"))
    return batch.text_check(manifest, X.text_lines(spark, sf_dir), errors)


@query
def j8_text_check(spark, sf_dir):
    return checked(spark, sf_dir).select("file", "row_num", "url", "image_id", "line_count", "char_count", "ocr_text", "has_text", "error")


@query
def j7_rows_with_text(spark, sf_dir):
    return batch.rows_with_text(tables.keep_http(X.derived(spark, sf_dir, X.MANIFEST)), checked(spark, sf_dir)).select("file", "row_num", "url")


@query
def s4_report(spark, sf_dir):
    return tables.report(checked(spark, sf_dir))


@query
def a1_meaningful_text(spark, sf_dir):
    return OL.has_meaningful_text(X.text_lines(spark, sf_dir), meta(spark, sf_dir))


@query
def a2_ocr_quality(spark, sf_dir):
    return OL.ocr_quality(X.text_lines(spark, sf_dir)).select("image_id", "total_lines", F.round("avg_len", 9).alias("avg_len"), "long_lines", "valid", "is_vertical", "need_rotation")


@query
def a3_page_text(spark, sf_dir):
    return OL.page_text(X.text_lines(spark, sf_dir)).select("image_id", "full_text", "total_lines")


@query
def a4_text_statistics(spark, sf_dir):
    return OL.ocr_text_check(X.text_lines(spark, sf_dir))


@query
def a5_batch_summary(spark, sf_dir):
    return batch.batch_summary(checked(spark, sf_dir))


@query
def a6_detect_result(spark, sf_dir):
    out = detect.detection_report(staged(X.text_lines(spark, sf_dir), "lines"))
    item = lambda x: F.concat_ws("|", x["text"], x["category"], F.array_join(F.transform(x["bbox"], lambda c: c.cast("string")), ","), x["ocr_line_index"].cast("string"))
    return out.select("image_id", "total_lines", "sensitive_count", F.coalesce(F.array_join(F.transform("items", item), ";"), F.lit("")).alias("items"))


@query
def a7_process_stats(spark, sf_dir):
    lines = staged(X.text_lines(spark, sf_dir), "lines")
    out = regions.process_stats(meta(spark, sf_dir), lines, detect.detect_rules(lines))
    return out.select("image_id", "total_lines", "sensitive_count", "masked_count", F.array_join("sensitive_items", ";").alias("sensitive_items"))


@query
def a8_source_counts(spark, sf_dir):
    every = staged(box_regions(spark, sf_dir), "boxes")
    return regions.source_counts(every, regions.dedupe_regions(every))


@query
def a9_dedupe_regions(spark, sf_dir):
    return regions.dedupe_regions(box_regions(spark, sf_dir)).select("image_id", "source", "seq", "paint_order")


@query
def a9_dense_images(spark, sf_dir):
    """Images of few and of many regions: overlaps of the dense ones go in rounds over a grid."""
    boxes = X.derived(spark, sf_dir, X.DENSE_BOXES)
    named = boxes.select("image_id", "source", "seq", rect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("polygon"))
    return regions.dedupe_any_size(named, at_most=200).select("image_id", "source", "seq", "paint_order")


@query
def a10_stage_latency(spark, sf_dir):
    out = batch.stage_latency(X.derived(spark, sf_dir, X.STAGE_METRICS), exact=True)
    return out.select("stage", "images", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms", "max_ms", "share")])


@query
def w2_paint_order(spark, sf_dir):
    return regions.paint_order(box_regions(spark, sf_dir)).select("image_id", "source", "seq", "paint_order")


@query
def w3_choose_orientation(spark, sf_dir):
    tries = X.derived(spark, sf_dir, X.ATTEMPTS).withColumn("bbox", rect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return OL.choose_orientation(tries)


@query
def u1_union_regions(spark, sf_dir):
    every = box_regions(spark, sf_dir)
    return every.withColumn("source_ord", regions.source_order()).groupBy("image_id", "source", "source_ord").agg(F.count("*").alias("n"))


@query
def f1_rule_values(spark, sf_dir):
    return rules.extract_values(X.text_lines(spark, sf_dir)).select("image_id", "line_index", "rule_no", "match_no", "category", "value", "prefix_miss")


@query
def f2_value_position(spark, sf_dir):
    lines = X.text_lines(spark, sf_dir)
    value = F.when(F.col("line_index") % 3 == 0, F.lit("医生：李四审核")).when(F.col("line_index") % 3 == 1, F.lit("岁条码")).otherwise(F.lit("：张"))
    return lines.select("image_id", "line_index", value_position(F.col("text"), value).alias("position"))


@query
def f3_rule_regions(spark, sf_dir):
    return flat_regions(rules.rule_regions(X.text_lines(spark, sf_dir)))


@query
def f4_llm_items(spark, sf_dir):
    return locate.parse_llm_items(X.llm_responses(spark, sf_dir)).select("image_id", "item_seq", "line_index", "text", "category", "signature")


@query
def f5_clean_item_text(spark, sf_dir):
    items = X.derived(spark, sf_dir, X.ITEMS)
    return items.select("image_id", "item_seq", locate.clean_item_text(F.col("text")).alias("cleaned"))


@query
def f6_signature_labels(spark, sf_dir):
    return flat_regions(rules.signature_label_regions(X.text_lines(spark, sf_dir)))


@query
def f9_signature_context(spark, sf_dir):
    return OL.signature_context(X.text_lines(spark, sf_dir))


@query
def f10_iou(spark, sf_dir):
    a = X.text_lines(spark, sf_dir).select("image_id", "line_index", *box_columns(F.col("bbox")))
    shifted = F.struct((F.col("x1") + 5).alias("x1"), (F.col("y1") + F.col("line_index")).alias("y1"), (F.col("x2") - 9).alias("x2"), (F.col("y2") + 3).alias("y2"))
    return a.select("image_id", "line_index", F.round(iou(F.struct("x1", "y1", "x2", "y2"), shifted), 9).alias("iou"))


@query
def f11_category_prompt(spark, sf_dir):
    chosen = F.when(F.col("request_id") % 2 == 0, F.array(F.lit("date"), F.lit("other"))).otherwise(F.array(F.lit("name"), F.lit("phone")))
    return Q.category_prompt(requests(spark, sf_dir).withColumn("categories", chosen)).select("request_id", "prompt")


@query
def f12_vision_lines(spark, sf_dir):
    lines = X.text_lines(spark, sf_dir)
    ids = meta(spark, sf_dir).select("image_id", F.lit("p").alias("prompt"))
    images = ids.select("image_id", F.encode(F.repeat(F.col("image_id").cast("string"), 40), "utf-8").alias("content"), F.lit("image/png").alias("media_type"))
    return Q.vision_requests(images, lines, ids)


@query
def f13_written_formats(spark, sf_dir):
    return flat_regions(rules.pattern_regions(X.text_lines(spark, sf_dir)))


@query
def f13_documents(spark, sf_dir):
    """Addresses and numbers told by their form in every line of the given documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line_index", "text"))
    found = rules.extract_values(lines, tuple(r for r in rules.FORMATS if r.category in ("email", "phone")))
    return found.groupBy("image_id", "category").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query
def x6_signature_regions(spark, sf_dir):
    runs, strokes = X.derived(spark, sf_dir, X.INK_RUNS), X.derived(spark, sf_dir, X.STROKES)
    areas = strokes.select("image_id", "area_id").distinct().select("*", F.lit(40).alias("ax1"), F.lit(90).alias("ay1"), F.lit(260).alias("ax2"), F.lit(200).alias("ay2"), F.lit(600).alias("width"), F.lit(800).alias("height"), F.element_at(F.array(*map(F.lit, ("near_doctor", "bottom_context", "bottom_strict", "verify"))), F.col("area_id") + 1).alias("profile"))
    found = signatures.signature_regions(strokes, runs, areas)
    return found.select("image_id", "seq", flat(F.col("polygon")).alias("polygon"), F.round("fill", 9).alias("fill"))


@query
def x7_bottom_areas(spark, sf_dir):
    return spatial.bottom_areas(X.text_lines(spark, sf_dir), meta(spark, sf_dir))


@query
def r1_stream_detect(spark, sf_dir):
    return flat_regions(jobs.stream_detect(X.text_lines(spark, sf_dir)))


@query
def r2_request_outcomes(spark, sf_dir):
    out = jobs.request_outcomes(X.derived(spark, sf_dir, X.REQUEST_LOG))
    return out.withColumn("avg_ms", F.round("avg_ms", 6))


@query
def r1_stream_replay(spark, sf_dir):
    """Regions of lines that arrive as files, over a stream that is broken off before its last commit and started again."""
    arrived, found, at = (fresh_path(spark, what) for what in ("lines", "regions", "checkpoint"))
    at_once = max(2, spark.sparkContext.defaultParallelism)  # files of a batch: one for each core
    X.text_lines(spark, sf_dir).repartition(3 * at_once, "image_id").write.parquet(arrived)
    lines = spark.read.parquet(arrived).schema
    start = lambda: jobs.run_available(flat_regions(jobs.stream_detect(spark.readStream.schema(lines).option("maxFilesPerTrigger", at_once).parquet(arrived))), found, at)
    start()
    jobs.forget_last_commit(spark, at)
    start()
    return jobs.finished_batches(spark, found, "image_id bigint, source string, seq bigint, text string, category string, polygon string, ocr_line_index int").drop("batch_id")


@query
def r2_stream_outcomes(spark, sf_dir):
    """Outcomes by window over a log in six deliveries, each from the checkpoint of the one before; rows a day behind are dropped."""
    arrived, found, at = (fresh_path(spark, what) for what in ("log", "outcomes", "checkpoint"))
    log = staged(X.derived(spark, sf_dir, X.ARRIVALS), "arrivals")
    for k in range(6):
        log.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(log.drop("arrival").schema).parquet(arrived)
        jobs.run_available(jobs.request_outcomes(stream, watermark="1 day"), found, at)
    kind = dict(log.dtypes)["ts"]
    out = jobs.finished_batches(spark, found, f"endpoint string, window_start {kind}, window_end {kind}, n_ok bigint, n_error bigint, avg_ms double")
    return out.withColumn("avg_ms", F.round("avg_ms", 6)).drop("batch_id")


@query
def wb_detect(spark, sf_dir):
    """Model items and rules together: the whole detection without pixels."""
    lines = staged(X.text_lines(spark, sf_dir), "lines")
    found = detect.detect(lines, X.llm_responses(spark, sf_dir), meta(spark, sf_dir))
    return flat_regions(found, "paint_order")


@query
def wb_detect_pixels(spark, sf_dir):
    """The whole detection over scans: model, rules, handwriting below the lines and below doctors, faces."""
    lines, scans = staged(X.text_lines(spark, sf_dir), "lines"), staged(X.scans(spark, sf_dir), "scans", rows_at_once=32)
    found = detect.detect_with_pixels(scans, lines, X.llm_responses(spark, sf_dir), X.derived(spark, sf_dir, X.FACES))
    return flat_regions(found, "paint_order")


def pixels(df: DataFrame, *more: str) -> DataFrame:
    """Height, width and a digest of each picture's bytes."""
    return df.select("image_id", *more, "image.height", "image.width", F.md5(F.hex("image.data")).alias("pixels"))


@query
def x1_mask_solid(spark, sf_dir):
    """Every picture, those without regions untouched (masked is false)."""
    return pixels(images.mask_images(X.pictures(spark, sf_dir), X.picture_regions(spark, sf_dir), "black"), "masked")


@query
def x1_mask_requests(spark, sf_dir):
    """Pictures painted in the mode of each request: all five modes in one pass over the pictures."""
    masked = images.mask_requests(X.pictures(spark, sf_dir), X.picture_regions(spark, sf_dir), X.derived(spark, sf_dir, X.MASK_REQUESTS))
    return pixels(masked, "request_id", "mask_mode", "masked")


@query
def x1_reject_requests(spark, sf_dir):
    return images.reject_requests(X.derived(spark, sf_dir, X.MASK_REQUESTS))


def rows_mode(image: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A mode of a caller's own: every second row black, the others white."""
    out = np.full_like(part, 255)
    out[1::2] = 0
    return out


@query
def d3_registered_mode(spark, sf_dir):
    """Pictures painted in a mode that this process registers."""
    images.register_mask_mode("rows", rows_mode)
    asked = X.derived(spark, sf_dir, X.MASK_REQUESTS).withColumn("mask_mode", F.lit("rows"))
    return pixels(images.mask_requests(X.pictures(spark, sf_dir), X.picture_regions(spark, sf_dir).where("seq = 0"), asked), "request_id", "mask_mode", "masked")


@query
def x1_mask_mosaic(spark, sf_dir):
    return pixels(images.mask_images(X.pictures(spark, sf_dir), X.picture_regions(spark, sf_dir).where("seq = 0"), "mosaic"), "masked")


@query
def wa_mask_batch(spark, sf_dir):
    """Only pictures with enough text are masked."""
    return pixels(detect.mask_batch(X.pictures(spark, sf_dir), X.text_lines(spark, sf_dir), X.picture_regions(spark, sf_dir)), "masked")


@query
def x3_rotate_images(spark, sf_dir):
    found = X.pictures(spark, sf_dir)
    return pixels(images.rotate_images(found, X.derived(spark, sf_dir, X.PICTURES)))


@query
def x4_ink_runs(spark, sf_dir):
    return signatures.ink_runs(X.pictures(spark, sf_dir, 1), X.derived(spark, sf_dir, X.PICTURE_AREAS))


@query
def x5_strokes(spark, sf_dir):
    runs = signatures.ink_runs(X.pictures(spark, sf_dir, 1), X.derived(spark, sf_dir, X.PICTURE_AREAS).where("area_id = 0"))
    return signatures.stroke_components(runs)


@query
def j9_images_with_regions(spark, sf_dir):
    out = regions.images_with_regions(X.derived(spark, sf_dir, X.PICTURES), X.picture_regions(spark, sf_dir))
    each = F.array_join(F.transform("polygons", flat), ";")
    return out.select("image_id", "masked", F.coalesce(each, F.lit("")).alias("polygons"))


@query
def s1_read_manifest(spark, sf_dir):
    """The manifest written as sheets and read again."""
    path = fresh_path(spark, "manifest")
    X.derived(spark, sf_dir, X.MANIFEST).drop("file").write.option("header", "true").csv(path)
    return tables.read_manifest(spark, path).select("row_num", "url", F.col("image_id").cast("bigint").alias("image_id"))


@query
def s1_row_numbers(spark, sf_dir):
    """Sheets without row numbers, large enough to be read in splits: each row's place in its sheet."""
    path = fresh_path(spark, "sheets")
    sheet = X.derived(spark, sf_dir, X.MANIFEST).withColumn("sheet", F.col("file"))
    sheet.repartition("file").sortWithinPartitions("file", "row_num").select("file", "sheet", "url", "image_id").write.partitionBy("file").option("header", "true").csv(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        read = tables.read_manifest(spark, path)
    finally:
        spark.conf.set(key, before)
    return read.select("sheet", "row_num", "url", F.col("image_id").cast("bigint").alias("image_id"))


@query
def s2_read_images(spark, sf_dir):
    """Pictures written as files and read again, a folder at a time; files that are no pictures come out with an error."""
    path = fresh_path(spark, "files")
    tables.write_files(tables.spread_names(X.picture_files(spark, sf_dir), X.derived(spark, sf_dir, X.PICTURES).count()), path)
    number = F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("bigint").alias("image_id")
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 10))  # thousands of such files make a task, not 32
    try:
        digests = lambda read: pixels(read.select(number, "image", "error"), "error").select("image_id", "height", "width", "pixels", "error")
        return tables.read_in_turns(spark, path, "*.bmp", digests)
    finally:
        spark.conf.set(key, before)


@query
def s3_repeated_jobs(spark, sf_dir):
    """Masked contents of two jobs that share keys, each run twice: every key is there once."""
    path = fresh_path(spark, "masked")
    known = U.parse_object_url(requests(spark, sf_dir)).where("url_error IS NULL").withColumn("content", F.encode("url", "utf-8"))
    named = U.derive_key(known, "masked", 1_700_000_000)
    # one row in ten names its original as the target
    named = named.withColumn("derived_key", F.when(F.col("request_id") % 10 == 0, F.col("key")).otherwise(F.col("derived_key")))
    for job, part in (("a", named.where("request_id % 3 < 2")), ("b", named.where("request_id % 3 > 0").withColumn("content", F.encode(F.lit("later"), "utf-8")))) * 2:
        tables.append_masked(part, path, job)
    return tables.read_masked(spark, path).select("key", "content_type", F.decode("content", "utf-8").alias("content"))


@query
def a10_daily_latency(spark, sf_dir):
    """Latencies of a range of days from sketches kept for each day: exact sums, and quantiles whose ranks are within a hundredth."""
    metrics = X.derived(spark, sf_dir, X.DAILY_METRICS)
    sketches = staged(batch.latency_sketches(metrics), "sketches").where("day >= DATE'1995-01-01' AND day < DATE'1997-01-01'")
    found = batch.latency_of_days(sketches)
    stack = ", ".join(f"'{s}', {s}" for s in batch.STAGES)
    long = metrics.where("day >= DATE'1995-01-01' AND day < DATE'1997-01-01'").selectExpr(f"stack({len(batch.STAGES)}, {stack}) AS (stage, ms)")
    below = [F.count_if(F.col("ms") < F.col(p)).alias(f"{p}_below") for p in ("p50_ms", "p95_ms")]
    upto = [F.count_if(F.col("ms") <= F.col(p)).alias(f"{p}_upto") for p in ("p50_ms", "p95_ms")]
    ranks = long.join(found, "stage").groupBy("stage").agg(*below, *upto)
    near = lambda p, q: (F.col(f"{p}_below") <= F.col("images") * (q + 0.01)) & (F.col(f"{p}_upto") >= F.col("images") * (q - 0.01))
    return found.join(ranks, "stage").select("stage", "images", F.round("avg_ms", 6).alias("avg_ms"), F.round("max_ms", 6).alias("max_ms"), F.round("share", 6).alias("share"), near("p50_ms", 0.5).alias("p50_near"), near("p95_ms", 0.95).alias("p95_near"))


@query
def s3_write_masked(spark, sf_dir):
    """Contents written under their new keys and read again."""
    path = fresh_path(spark, "masked")
    known = U.parse_object_url(requests(spark, sf_dir)).where("url_error IS NULL").withColumn("content", F.encode("url", "utf-8"))
    tables.write_masked(U.derive_key(known, "masked", F.col("request_id") + 1_700_000_000), path)
    return spark.read.parquet(path).select("key", "content_type", F.decode("content", "utf-8").alias("content"))


@query
def p10_normalize_legacy(spark, sf_dir):
    """Results in the older shape: one array of polygon, text and score."""
    found = X.derived(spark, sf_dir, X.BOXED_LINES)
    half = lambda c: F.col(c) + F.lit(0.5)
    poly = F.array(F.array(half("x1"), half("y1")), F.array(half("x2"), half("y1")), F.array(half("x2"), half("y2")), F.array(half("x1"), half("y2")))
    line = F.struct("line_index", poly.alias("poly"), F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("o_orderkey") % 7 != 0, F.col("confidence")).alias("conf"))
    raw = found.groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("a"))
    none = lambda kind: F.lit(None).cast(kind)
    raw = raw.select("image_id", none("array<string>").alias("rec_texts"), none("array<array<array<double>>>").alias("dt_polys"), none("array<double>").alias("rec_scores"), F.transform("a", lambda x: F.struct(x["poly"].alias("poly"), x["text"].alias("text"), x["conf"].alias("conf"))).alias("legacy"))
    return L.normalize_ocr(raw).select("image_id", "line_index", "text", flat(F.col("bbox")).alias("polygon"), "confidence")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
