"""Tables of lines, answers, requests and boxes derived from the given order, page and event tables.

The given tables hold no scanned documents, so registered queries read them through these
derivations; they grow with the tables that they come from. SQL texts run on Spark and DuckDB.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.geometry import rect
from inkveil.operators.images import pixels_of

#: One image for each customer, a line for each order.
LABEL_LINES = """
SELECT CAST(o_custkey AS BIGINT) AS image_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_index,
       CASE o_orderkey % 10
         WHEN 0 THEN '姓名：张三'
         WHEN 1 THEN '报告医生：李四 审核医师：王小五'
         WHEN 2 THEN '检查医生：'
         WHEN 3 THEN concat('病历号：A', CAST(o_orderkey AS STRING))
         WHEN 4 THEN '采样人：赵六'
         WHEN 5 THEN '手签：'
         WHEN 6 THEN concat('联系电话 1', CAST(3000000000 + o_orderkey * 7919 AS STRING))
         WHEN 7 THEN concat('检查日期：2026-01-', CAST(10 + o_orderkey % 19 AS STRING))
         WHEN 8 THEN concat('年龄 ', CAST(20 + o_orderkey % 60 AS STRING), '岁 条码:B_', CAST(o_orderkey AS STRING))
         ELSE '所见正常' END AS text,
       (50 + o_orderkey % 50) / CAST(100 AS DOUBLE) AS confidence,
       o_orderkey
FROM orders
"""

#: The same with the line's box as four whole numbers.
BOXED_LINES = f"""
SELECT image_id, line_index, text, confidence, o_orderkey,
       CAST(11 + 3 * (image_id % 5) AS INT) AS x1, CAST(7 + 31 * line_index AS INT) AS y1,
       CAST(11 + 3 * (image_id % 5) + 23 * length(text) AS INT) AS x2, CAST(33 + 31 * line_index AS INT) AS y2
FROM ({LABEL_LINES}) label_lines
"""

#: A model's items for every second line: some name a line too far, some carry their label or one character too many.
ITEMS = f"""
SELECT image_id, line_index AS item_seq,
       CAST(line_index + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS INT) AS line_index,
       CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '姓名：张三' WHEN o_orderkey % 3 = 1 THEN '小张三' ELSE '张三' END
            WHEN o_orderkey % 10 = 1 THEN '李四' WHEN o_orderkey % 10 = 2 THEN '检查医生：'
            WHEN o_orderkey % 10 = 3 THEN concat('A', CAST(o_orderkey AS STRING))
            WHEN o_orderkey % 10 = 4 THEN '采样人赵六' ELSE '没有' END AS text,
       CASE WHEN o_orderkey % 10 = 1 THEN 'doctor' WHEN o_orderkey % 10 = 3 THEN 'medical_id' ELSE 'name' END AS category
FROM ({LABEL_LINES}) label_lines WHERE o_orderkey % 10 < 6
"""

IMAGE_META = """
SELECT CAST(c_custkey AS BIGINT) AS image_id, CAST(600 + c_custkey % 1500 AS INT) AS width,
       CAST(400 + (c_custkey * 7) % 2100 AS INT) AS height, CAST(c_custkey % 9 AS INT) AS exif_orientation
FROM customer
"""

REQUESTS = """
SELECT page_id AS request_id, page_id AS image_id,
       CASE page_id % 4 WHEN 0 THEN concat('https://B-', CAST(page_id % 7 AS STRING), '.cos.ap-nanjing.myqcloud.com/f/a%20b+', CAST(page_id AS STRING), '.JPG?sign=1')
            WHEN 1 THEN concat('https://cdn.example.com/g/', CAST(page_id AS STRING), '.tar.png')
            WHEN 2 THEN concat('http://c-1.cos.ap-shanghai.tencentcos.cn//x/', CAST(page_id AS STRING))
            ELSE url END AS url,
       CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'other' END AS llm_provider,
       CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'black' WHEN 2 THEN 'gray' WHEN 3 THEN 'blur' WHEN 4 THEN 'mosaic' ELSE 'invalid-mode' END AS mask_mode,
       CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CUDA out of memory' WHEN 2 THEN 'CUDNN_STATUS_X' WHEN 3 THEN '' ELSE 'timeout' END AS message
FROM pages
"""

#: Sheets of a thousand rows each.
MANIFEST = """
SELECT concat('part', CAST(CAST(floor(page_id / 1000) AS BIGINT) AS STRING)) AS file,
       CAST(2 + page_id % 1000 AS INT) AS row_num,
       CASE WHEN page_id % 11 = 0 THEN concat('  ', url, ' ') WHEN page_id % 13 = 0 THEN concat('ftp:', url) ELSE url END AS url,
       CAST(page_id AS BIGINT) AS image_id
FROM pages
"""

FACES = """
SELECT CAST(1 + p_partkey % 150 AS BIGINT) AS image_id, CAST(p_partkey % 700 - 20 AS INT) AS x, CAST((p_partkey * 3) % 500 - 10 AS INT) AS y,
       CAST(8 + p_size AS INT) AS w, CAST(10 + (p_partkey * 7) % 60 AS INT) AS h
FROM part
"""

INK_RUNS = """
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS image_id, CAST(floor(p_partkey / 50) % 4 AS INT) AS area_id, CAST(100 + (p_partkey * 7) % 60 AS INT) AS y,
       CAST(50 + (p_partkey * 13) % 150 AS INT) AS x1, CAST(54 + (p_partkey * 13) % 150 + p_size % 9 AS INT) AS x2 FROM part
"""

STROKES = """
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS image_id, CAST(floor(p_partkey / 50) % 4 AS INT) AS area_id, CAST(50 + (p_partkey * 13) % 150 AS INT) AS x,
       CAST(100 + (p_partkey * 7) % 60 AS INT) AS y, CAST(10 + p_size AS INT) AS w, CAST(5 + p_size % 20 AS INT) AS h, CAST(20 + p_partkey % 500 AS INT) AS size FROM part
"""

#: Small pictures, one for each part; their pixels follow from the id and the place.
PICTURES = """
SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(20 + p_partkey % 23 AS INT) AS width, CAST(16 + p_size % 31 AS INT) AS height, CAST(90 * (p_size % 4) AS INT) AS angle FROM part
"""

#: Boxes on the pictures of larger parts: one, or two for the largest; some reach past the picture's edge.
PICTURE_BOXES = """
SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS seq, CAST(p_partkey % 7 AS INT) AS x1, CAST(p_partkey % 5 AS INT) AS y1,
       CAST(p_partkey % 7 + 8 + p_partkey % 19 AS INT) AS x2, CAST(p_partkey % 5 + 6 + p_partkey % 33 AS INT) AS y2 FROM part WHERE p_size > 15
UNION ALL
SELECT CAST(p_partkey AS BIGINT), CAST(1 AS BIGINT), CAST(10 + p_partkey % 4 AS INT), CAST(2 + p_partkey % 11 AS INT),
       CAST(17 + p_partkey % 9 AS INT), CAST(9 + p_partkey % 11 + p_partkey % 13 AS INT) FROM part WHERE p_size > 35
"""

#: Two requests for each picture, in modes of their own; some name no mode, some an unknown one.
MASK_REQUESTS = """
SELECT CAST(page_id AS BIGINT) AS request_id, CAST(1 + floor(page_id / 2) AS BIGINT) AS image_id,
       CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'black' WHEN 2 THEN 'gray' WHEN 3 THEN 'blur' WHEN 4 THEN 'mosaic' WHEN 5 THEN 'white' ELSE 'invalid-mode' END AS mask_mode FROM pages
"""

#: Two areas of each picture in which ink is looked for; the second reaches past the edge.
PICTURE_AREAS = """
SELECT CAST(p_partkey AS BIGINT) AS image_id, 0 AS area_id, 2 AS ax1, 1 AS ay1, 12 AS ax2, 9 AS ay2 FROM part
UNION ALL SELECT CAST(p_partkey AS BIGINT), 1, CAST(8 + p_partkey % 9 AS INT), 10, 60, 40 FROM part WHERE p_size > 25
"""

#: Boxes of two detectors: half of all on the first image, the rest on one image for each thousand parts.
DENSE_BOXES = """
SELECT CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 + floor(p_partkey / 1000) END AS BIGINT) AS image_id, CASE WHEN p_partkey % 3 = 0 THEN 'rule' ELSE 'llm' END AS source, CAST(p_partkey AS BIGINT) AS seq,
       CAST((p_partkey * 37) % 1900 AS INT) AS x1, CAST((p_partkey * 53) % 1300 AS INT) AS y1,
       CAST((p_partkey * 37) % 1900 + 8 + (p_size * 7) % 90 AS INT) AS x2, CAST((p_partkey * 53) % 1300 + 8 + p_partkey % 61 AS INT) AS y2 FROM part
"""

#: Sizes of whole scans, one for each customer.
SCAN_META = """
SELECT CAST(c_custkey AS BIGINT) AS image_id, CAST(640 + c_custkey % 160 AS INT) AS width, CAST(360 + (c_custkey * 7) % 200 AS INT) AS height FROM customer
"""

#: Strokes of ink on a scan, which don't touch one another: up to seven below the last line, and five among the lines of some.
SCAN_INK = f"""
SELECT image_id, CAST(20 + 20 * (image_id % 5) + 26 * j AS INT) AS x, CAST(45 + 31 * last + (j * 5) % 9 AS INT) AS y,
       CAST(6 + (image_id + j) % 13 AS INT) AS w, CAST(14 + (image_id + 3 * j) % 17 AS INT) AS h
FROM (SELECT image_id, max(line_index) AS last FROM ({LABEL_LINES}) label_lines GROUP BY image_id) ends CROSS JOIN (SELECT explode(sequence(0, 6)) AS j) slots WHERE j <= image_id % 7
UNION ALL
SELECT image_id, CAST(60 + 26 * j AS INT), CAST(70 + (j * 7) % 10 AS INT), CAST(9 AS INT), CAST(20 AS INT)
FROM (SELECT image_id, max(line_index) AS last FROM ({LABEL_LINES}) label_lines GROUP BY image_id) ends CROSS JOIN (SELECT explode(sequence(0, 4)) AS j) slots WHERE image_id % 8 = 0 AND last >= 4
"""

STAGE_METRICS = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS DOUBLE) AS orientation_ms, l_quantity AS ocr_ms, l_discount AS rotation_retry_ms,
       l_extendedprice AS detect_ms, l_tax AS mask_ms FROM lineitem
"""

DAILY_METRICS = STAGE_METRICS.replace(" FROM lineitem", ", CAST(l_shipdate AS DATE) AS day FROM lineitem")

REQUEST_LOG = """
SELECT event_id AS request_id, ts, event_type AS endpoint, CASE WHEN event_type = 'error' OR event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, value AS elapsed_ms FROM events
"""

#: The log as it arrives: five days in each of six deliveries, every thirteenth row one delivery late.
ARRIVALS = f"""
SELECT request_id, ts, endpoint, status, elapsed_ms, CAST(least(5, floor((day(ts) - 1) / 5) + CASE WHEN request_id % 13 = 0 THEN 1 ELSE 0 END) AS INT) AS arrival FROM ({REQUEST_LOG}) request_log
"""

#: Up to four attempts for each image; later ones with other numbers of lines and upright boxes.
ATTEMPTS = " UNION ALL ".join(f"""
SELECT image_id, {a} AS attempt, {angle} AS angle, line_index,
       CASE WHEN (image_id + {a}) % 5 = 0 THEN substring(text, 1, 2) ELSE text END AS text,
       x1, y1, CAST(CASE WHEN (image_id * 3 + {a}) % 4 = 0 THEN x1 + 9 ELSE x2 END AS INT) AS x2, y2
FROM ({BOXED_LINES}) boxed WHERE (line_index + {a} * image_id) % (2 + {a}) <> 1
""" for a, angle in enumerate((0, 90, 270, 180)))

DOMAIN_MAP = "SELECT 1 AS ordinal, 'cdn.example.com' AS domain, 'example-1250000000' AS bucket, 'ap-nanjing' AS region UNION ALL SELECT 2, 'img.example.org', 'b-3', 'ap-nanjing'"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derivation over the given tables of a folder."""
    names = [n for n in ("orders", "customer", "pages", "part", "lineitem", "events") if f"FROM {n}" in sql]
    for n in names:
        sql = sql.replace(f"FROM {n}\n", f"FROM {{{n}}}\n").replace(f"FROM {n} ", f"FROM {{{n}}} ")
        sql = sql[: -len(n)] + f"{{{n}}}" if sql.endswith(f"FROM {n}") else sql
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = derived(spark, sf_dir, BOXED_LINES)
    return boxed.select("image_id", "line_index", "text", rect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("bbox"), "confidence")


DRAWN_BYTES = 16 << 20  # of pictures that leave a task at once
IMAGE_FIELDS = pa.struct([("origin", pa.string()), *[(c, pa.int32()) for c in ("height", "width", "nChannels", "mode")], ("data", pa.binary())])
IMAGE_STRUCT = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def dealt(df: DataFrame) -> DataFrame:
    """Rows that will grow (ids that become pixels), dealt to several tasks a core first: their few bytes would stay in one."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "image_id")


def parts_of(sizes: np.ndarray, most: int = DRAWN_BYTES) -> list[slice]:
    """Consecutive rows of at most `most` bytes in all, one row at least."""
    ends, out, low = np.cumsum(sizes), [], 0
    while low < len(sizes):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")), low + 1)
        out.append(slice(low, high))
        low = high
    return out


def pictures(spark: SparkSession, sf_dir: str, channels: int = 3) -> DataFrame:
    """PICTURES with Spark's image struct: the byte at place i is (7 id + 13 i + 31 (i div 5)) mod 256."""
    found = derived(spark, sf_dir, PICTURES)

    def draw(batches):  # noqa: ANN001, ANN202
        base = np.zeros(0, np.uint8)
        for whole in batches:
            sizes = np.multiply(*(whole.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width"))) * channels
            if sizes.max(initial=0) > len(base):
                place = np.arange(sizes.max(), dtype=np.int64)
                base = ((13 * place + 31 * (place // 5)) % 256).astype(np.uint8)
            for part in parts_of(sizes):
                batch, n = whole.slice(part.start, part.stop - part.start), sizes[part]
                first = (batch.column("image_id").fill_null(0).to_numpy(zero_copy_only=False) * 7 % 256).astype(np.uint8)
                data = np.concatenate([base[:k] for k in n]) + np.repeat(first, n)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                known = pc.and_(*(pc.is_valid(batch.column(c)) for c in ("height", "width")))
                same = lambda v: pa.array(np.full(len(n), v), pa.int32())  # noqa: B023, E731
                fields = [pa.array([""] * len(n)), batch.column("height"), batch.column("width"), same(channels), same(16 if channels == 3 else 0), pc.if_else(known, binary, None)]
                image = pa.StructArray.from_arrays(fields, fields=list(IMAGE_FIELDS))
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("angle"), image], names=["image_id", "angle", "image"])

    return dealt(found).select("image_id", "angle", "height", "width").mapInArrow(draw, f"image_id bigint, angle int, image {IMAGE_STRUCT}")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, image: gray scans of SCAN_META's sizes, white with print (lighter than ink) in the lines' boxes and SCAN_INK's strokes."""
    boxes = derived(spark, sf_dir, BOXED_LINES).select("image_id", "x1", "y1", "x2", "y2", F.lit(150).alias("gray"))
    ink = derived(spark, sf_dir, SCAN_INK).select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(30).alias("gray"))
    marks = boxes.unionByName(ink).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gray", "x1", "y1", "x2", "y2")), asc=False).alias("marks"))
    drawn = dealt(derived(spark, sf_dir, SCAN_META).join(marks, "image_id", "left"))

    def draw(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            sizes = np.multiply(*(whole.column(c).to_numpy().astype(np.int64) for c in ("height", "width")))
            for part in parts_of(sizes):  # few scans leave at once
                batch, out = whole.slice(part.start, part.stop - part.start), []
                for row in batch.to_pylist():
                    pixels = np.full((row["height"], row["width"]), 255, np.uint8)
                    for m in row["marks"] or ():
                        pixels[max(m["y1"], 0) : max(m["y2"], 0), max(m["x1"], 0) : max(m["x2"], 0)] = m["gray"]
                    out.append({"origin": "", "height": row["height"], "width": row["width"], "nChannels": 1, "mode": 0, "data": pixels.tobytes()})
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, IMAGE_FIELDS)], names=["image_id", "image"])

    return drawn.mapInArrow(draw, f"image_id bigint, image {IMAGE_STRUCT}")


def picture_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived(spark, sf_dir, PICTURE_BOXES)
    return found.select("image_id", "seq", rect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("polygon"))


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content: the pictures as bitmap files; every ninth is cut off within its header, every eleventh empty."""

    def encode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            names, contents = [], []
            for k, image_id in enumerate(batch.column("image_id").to_pylist()):
                pixels = pixels_of(batch.column("image"), k)
                h, w, _ = pixels.shape
                rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)  # rows from the bottom, filled up to whole words
                rows[:, : 3 * w] = pixels[::-1].reshape(h, 3 * w)
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
                whole = head + rows.tobytes()
                names.append(f"{image_id % 10}/{image_id}.bmp")
                contents.append(whole[:20] if image_id % 9 == 0 else b"" if image_id % 11 == 0 else whole)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    return pictures(spark, sf_dir).select("image_id", "image").mapInArrow(encode, "name string, content binary")


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as JSON arrays, every third in a code fence, every eleventh cut off, plus a signature box for some images."""
    item = F.struct("item_seq", F.to_json(F.struct(F.col("line_index"), "text", "category")).alias("json"))
    out = derived(spark, sf_dir, ITEMS).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["json"]), ",").alias("body"))
    sign = F.when(F.col("image_id") % 4 == 0, F.concat(F.lit(',{"type":"handwritten_signature","bbox_pct":['), (F.col("image_id") % 50).cast("string"), F.lit(",10,"), (F.col("image_id") % 130).cast("string"), F.lit(",30.5]}"))).otherwise("")
    raw = F.concat(F.lit("["), "body", sign, F.lit("]"))
    raw = F.when(F.col("image_id") % 11 == 0, F.substr(raw, F.lit(1), F.length(raw) - 3)).otherwise(raw)
    return out.select("image_id", F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw).alias("raw"))
