"""Small worked cases and slow statements of the rules."""

import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkveil.functions import engines, lines, requests, urls
from inkveil.functions.geometry import rect, value_polygon, value_position
from inkveil.operators import images, locate, regions, rules, signatures
from inkveil.operators import lines as grouped
from inkveil.plans import batch, detect
from inkveil.sources import tables
from inkveil.streaming import jobs

BOX = [[0, 0], [100, 0], [100, 20], [0, 20]]
LINE = "image_id bigint, line_index int, text string, bbox array<array<int>>, confidence double"


def text_lines(spark, *texts, image_id=1, confidence=0.9):
    return spark.createDataFrame([(image_id, k, t, [[10, 30 * k], [10 + 20 * max(1, len(t)), 30 * k], [10 + 20 * max(1, len(t)), 30 * k + 20], [10, 30 * k + 20]], confidence) for k, t in enumerate(texts)], LINE)


def slow_polygon(bbox, text, value, miss):
    """The polygon rule stated for one row."""
    pts = np.array(bbox, float)
    xs, ys = pts[:, 0], pts[:, 1]
    pad = max(2, int(max(ys.max() - ys.min(), 1) * 0.15))
    pos = text.find(value)
    if pos < 0:
        clean = text.replace(" ", "").find(value.replace(" ", ""))
        if clean >= 0:
            pos = [i for i, c in enumerate(text) if c != " "][clean] if text.replace(" ", "") else -1
    n = max(len(text), 1)
    a, b = (0.0, 1.0) if pos < 0 or pos == 0 and len(value) >= n else (max(0.0, pos / n - miss * (1.0 / n)), (pos + len(value)) / n)
    tl, tr, br, bl = pts[:4]
    corners = [tl + (tr - tl) * a, tl + (tr - tl) * b, bl + (br - bl) * b, bl + (br - bl) * a]
    mid = (corners[0] + corners[1] + corners[2] + corners[3]) / 4
    out = []
    for c in corners:
        d = math.hypot(*(c - mid))
        out.append([int(v) for v in (c + (c - mid) / d * pad if d else c)])
    return out


def test_value_polygon_against_slow_statement(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(200):
        text = "".join(rng.choice("ab c李四：") for _ in range(rng.randint(1, 12)))
        i = rng.randrange(len(text))
        value = rng.choice([text[i : i + 3], text, "zz", text.replace(" ", "")[:4] or "q"]) or "q"
        x, y = rng.randint(-5, 50), rng.randint(-5, 50)
        quad = [[x, y], [x + rng.randint(20, 90), y + rng.randint(-3, 3)], [x + rng.randint(20, 90), y + rng.randint(10, 30)], [x + rng.randint(-3, 3), y + rng.randint(10, 30)]]
        cases.append((text, value, quad, rng.randint(0, 2)))
    df = spark.createDataFrame(cases, "text string, value string, bbox array<array<int>>, miss int")
    got = df.select(value_polygon(F.col("bbox"), F.col("text"), F.col("value"), prefix_miss=F.col("miss"))).collect()
    for case, row in zip(cases, got, strict=True):
        want = slow_polygon(case[2], case[0], case[1], case[3])
        # one unit of room where a coordinate lies on a whole number
        assert np.abs(np.array(row[0]) - np.array(want)).max() <= 1, case


def test_value_position_ignores_blanks_only_as_a_fallback(spark):
    df = spark.createDataFrame([("ab cd", "b c"), ("a b", "ab"), ("ab", "x"), ("", "x"), (" a b", "ab")], "t string, v string")
    assert [r[0] for r in df.select(value_position(F.col("t"), F.col("v"))).collect()] == [1, 0, -1, -1, 1]


def test_malformed_box_becomes_its_rectangle(spark):
    df = spark.createDataFrame([("ab", "ab", [[0, 0], [10, 10], [4, 2]])], "text string, value string, bbox array<array<int>>")
    got = df.select(value_polygon(F.col("bbox"), F.col("text"), F.col("value"))).first()[0]
    assert got == slow_polygon([[0, 0], [10, 0], [10, 10], [0, 10]], "ab", "ab", 0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("报告医生：李四 审核医师：王小五", [("doctor", "李四"), ("doctor", "王小五")]),
        ("检查医生：", []),
        ("主治医师：张三报告", [("doctor", "张三")]),
        ("病历号：A1-2.3 条码:B_9", [("medical_id", "A1-2.3"), ("medical_id", "B_9")]),
        ("采样人：赵六七八九", [("name", "赵六七八")]),
        ("", []),
    ],
)
def test_label_rules(spark, text, want):
    got = rules.extract_values(text_lines(spark, text)).orderBy("rule_no", "match_no").collect()
    assert [(r.category, r.value) for r in got] == want


def test_formats(spark):
    text = "33岁 2026年1月18日 13800138000 a.b@c-d.example.org 11010519491231002X"
    got = rules.extract_values(text_lines(spark, text), rules.FORMATS).collect()
    assert {(r.category, r.value) for r in got} == {("age", "33岁"), ("date", "2026年1月18日"), ("phone", "13800138000"), ("email", "a.b@c-d.example.org"), ("id_card", "11010519491231002X")}


def test_empty_label_gives_way_to_print(spark):
    free = text_lines(spark, "检查医生：")
    assert rules.empty_label_regions(free).count() == 1
    beside = spark.createDataFrame([(1, 9, "印刷", [[115, 2], [150, 2], [150, 18], [115, 18]], 0.9)], LINE)
    assert rules.empty_label_regions(free.unionByName(beside)).count() == 0
    assert rules.empty_label_regions(free.unionByName(beside.withColumn("confidence", F.lit(0.7)))).count() == 1


def test_locate_tiers(spark):
    ls = text_lines(spark, "张三", "正国", "张三", "李四")
    items = spark.createDataFrame([(1, 0, 1, "张三", "name"), (1, 1, 3, "李正国", "name"), (1, 2, 3, "李四", "name"), (1, 3, 0, "没有", "name")], "image_id bigint, item_seq int, line_index int, text string, category string")
    got = {r.item_seq: (r.found_line, r.matched, r.prefix_miss) for r in locate.locate_llm_items(items, ls).collect()}
    assert got == {0: (0, "张三", 0), 1: (1, "正国", 1), 2: (3, "李四", 0)}


def test_answers_of_any_shape(spark):
    raws = ['```json\n[{"line_index": 1, "text": " 姓名：张三 "}]\n```', "[]", "", None, '[{"line_index": 1, "te', '{"line_index": 1, "text": "x"}', '[{"index": "2", "text": "姓名："}, {"line_index": -1, "text": "x"}, {"text": "y"}, {"type": "handwritten_signature", "bbox_pct": [1, 2, 3, 4]}]']
    df = spark.createDataFrame(list(enumerate(raws)), "image_id bigint, raw string")
    assert [r.parse_status for r in locate.parsed_answers(df).orderBy("image_id").collect()] == ["ok", "empty", "empty", "empty", "bad_json", "bad_items", "ok"]
    got = [(r.image_id, r.item_seq, r.line_index, r.text, r.signature) for r in locate.parse_llm_items(df).orderBy("image_id", "item_seq").collect()]
    assert got == [(0, 0, 1, "张三", False), (6, 3, None, None, True)]


def test_dedupe_keeps_touching_threshold_and_order(spark):
    schema = "image_id bigint, source string, seq bigint, text string, category string, polygon array<array<int>>, ocr_line_index int"
    square = lambda x, w: [[x, 0], [x + w, 0], [x + w, 10], [x, 10]]
    rows = [(1, "rule", 0, "a", "c", square(0, 10), 0), (1, "llm", 0, "b", "c", square(0, 10), 0), (1, "rule", 1, "d", "c", square(100, 13), 0), (1, "rule", 2, "e", "c", square(107, 13), 0)]
    got = regions.dedupe_regions(spark.createDataFrame(rows, schema)).orderBy("paint_order").collect()
    # the overlap of d and e is 6/20 = 0.3, which is not over the limit; the model's box wins the tie
    assert [r.text for r in got] == ["d", "e", "b"]


def test_dedupe_of_regions_with_the_same_keys(spark):
    schema = "image_id bigint, source string, seq bigint, text string, category string, polygon array<array<int>>, ocr_line_index int, extra string"
    square = lambda w: [[7, 7], [7 + w, 7], [7 + w, 7 + w], [7, 7 + w]]
    rows = [(1, "face", 700007, "x", "portrait", square(w), -1, f"e{w}") for w in (48, 50, 10)] + [(2, "face", 700007, "x", "portrait", square(48), -1, "other")]
    df = spark.createDataFrame(rows, schema)
    got = regions.dedupe_regions(df)
    assert got.columns == [*df.columns, "paint_order"]
    # one of two faces at one corner goes; the small one overlaps by less
    assert [(r.image_id, r.extra, r.paint_order) for r in got.orderBy("image_id", "paint_order").collect()] == [(1, "e50", 1), (1, "e10", 2), (2, "other", 1)]
    twice = regions.dedupe_twice(df.where("extra <> 'e10'"), df.where("extra = 'e10'"))
    assert sorted(r.extra for r in twice.collect()) == ["e10", "e50", "other"]
    assert regions.dedupe_regions(df.limit(0)).count() == 0


def test_detection_needs_no_self_join(spark, capsys):
    schema = "image_id bigint, source string, seq bigint, text string, category string, polygon array<array<int>>, ocr_line_index int"
    df = spark.createDataFrame([], schema)
    regions.dedupe_twice(df, df).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_dedupe_twice_differs_from_once(spark):
    schema = "image_id bigint, source string, seq bigint, text string, category string, polygon array<array<int>>, ocr_line_index int"
    bar = lambda a, b: [[a, 0], [b, 0], [b, 10], [a, 10]]
    llm = spark.createDataFrame([(1, "llm", 0, "big", "c", bar(0, 100), 0), (1, "llm", 1, "small", "c", bar(60, 100), 0)], schema)
    rule = spark.createDataFrame([(1, "rule", 0, "huge", "c", bar(-90, 95), 0)], schema)
    assert {r.text for r in regions.dedupe_twice(llm, rule).collect()} == {"huge"}
    assert {r.text for r in regions.dedupe_regions(llm.unionByName(rule)).collect()} == {"huge", "small"}


def test_orientation_fold(spark):
    def attempt(k, angle, n, upright):
        w, h = (10, 40) if upright else (40, 10)
        return [(1, k, angle, i, "文字内容", [[0, 0], [w, 0], [w, h], [0, h]]) for i in range(n)]

    schema = "image_id bigint, attempt int, angle int, line_index int, text string, bbox array<array<int>>"
    pick = lambda rows: grouped.choose_orientation(spark.createDataFrame(rows, schema)).first().angle
    assert pick(attempt(0, 0, 5, True) + attempt(1, 90, 5, False) + attempt(2, 270, 9, False)) == 270
    assert pick(attempt(0, 0, 2, False) + attempt(1, 90, 5, False) + attempt(2, 270, 9, False)) == 90
    assert pick(attempt(1, 90, 3, False)) == 90


def test_normalize_numbers_before_dropping_boxes(spark):
    box = [[float(v) for v in p] for p in BOX]
    raw = spark.createDataFrame(
        [Row(image_id=1, rec_texts=["a", " ", "b", "c", "d"], dt_polys=[box, box, box[:3], None, [[0.5, 1.5], [2.5, 0.0], [1.0, 1.0], [0.0, 9.49]]], rec_scores=[0.5])],
        "image_id bigint, rec_texts array<string>, dt_polys array<array<array<double>>>, rec_scores array<double>",
    )
    got = [(r.line_index, r.text, r.confidence) for r in lines.normalize_ocr(raw).orderBy("line_index").collect()]
    assert got == [(0, "a", 0.5), (2, "d", 0.0)]
    assert lines.normalize_ocr(raw).where("text = 'd'").first().bbox == [[0, 2], [2, 0], [1, 1], [0, 9]]


def test_urls_and_keys(spark):
    df = spark.createDataFrame([("https://example-1250000000.cos.ap-shanghai.myqcloud.com/test/form/a%20b+c.png?x=1",), ("https://nowhere.example.com/k",)], "url string")
    a, b = urls.parse_object_url(df).collect()
    assert (a.bucket, a.region, a.key) == ("example-1250000000", "ap-shanghai", "test/form/a b+c.png")
    assert b.url_error == "unknown host" and b.key is None
    keys = spark.createDataFrame([("d/x.tar.gz",), ("d/x",), (".hidden",)], "key string")
    assert [r.derived_key for r in urls.derive_key(keys, "masked", 7).collect()] == ["d/x.tar_masked_7.gz", "d/x_masked_7", ".hidden_masked_7"]
    ok = urls.filter_supported_ext(spark.createDataFrame([("a/b.JPG?q=.exe",), ("a/b",), ("a/b.gif",), ("https://host.com",)], "url string"))
    assert [r.ext_ok for r in ok.collect()] == [True, True, False, False]


def test_errors_and_defaults(spark):
    df = spark.createDataFrame([(None,), ("CUDA Out Of Memory",), ("",)], "message string")
    assert [r.outcome for r in requests.classify_errors(df).collect()] == ["ok", "overload", "error"]


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def picture(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (60, 300, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    df = tables.read_images(spark, str(tmp_path), "*.png", decoded=True).select(F.lit(1).cast("bigint").alias("image_id"), "image")
    return pixels, df


def as_pixels(row):
    return np.frombuffer(row.image["data"], np.uint8).reshape(row.image["height"], row.image["width"], row.image["nChannels"])


@pytest.mark.parametrize("mode", ["white", "black", "gray", "blur", "mosaic"])
def test_masks(spark, picture, mode):
    pixels, df = picture
    schema = "image_id bigint, seq bigint, polygon array<array<int>>"
    got = as_pixels(images.mask_images(df, spark.createDataFrame([(1, 0, [[10, 10], [40, 10], [40, 40], [10, 40]])], schema), mode).first())
    inside = np.zeros(pixels.shape[:2], bool)
    inside[10:41, 10:41] = True
    assert (got[~inside] == pixels[~inside]).all()
    part = got[10:41, 10:41].astype(int)
    if mode in ("white", "black", "gray"):
        assert (part == {"white": 255, "black": 0, "gray": 128}[mode]).all()
    elif mode == "mosaic":
        assert len(np.unique(part.reshape(-1, 3), axis=0)) <= 4
    else:
        assert part.std() < pixels[10:41, 10:41].std() / 3


def test_images_without_regions_pass_through(spark, picture):
    pixels, df = picture
    row = images.mask_images(df, spark.createDataFrame([], "image_id bigint, seq bigint, polygon array<array<int>>")).first()
    assert not row.masked and (as_pixels(row) == pixels).all()
    off = images.mask_images(df, spark.createDataFrame([(1, 0, [[-20, -20], [-5, -20], [-5, -5], [-20, -5]])], "image_id bigint, seq bigint, polygon array<array<int>>")).first()
    assert (as_pixels(off) == pixels).all()


def test_rotation_and_own_mode(spark, picture):
    pixels, df = picture
    turned = as_pixels(images.rotate_images(df, spark.createDataFrame([(1, 90)], "image_id bigint, angle int")).first())
    assert (turned == np.rot90(pixels, -1)).all()
    images.register_mask_mode("red", lambda image, part: np.full_like(part, [0, 0, 255]))
    got = as_pixels(images.mask_images(df, spark.createDataFrame([(1, 0, BOX)], "image_id bigint, seq bigint, polygon array<array<int>>"), "red").first())
    assert (got[0, 0] == [0, 0, 255]).all()
    # requests may name it then
    named = spark.createDataFrame([("red",), ("mosaic",), ("violet",), (None,)], "mask_mode string")
    assert [r.mode_ok for r in requests.validate_mask_mode(named).collect()] == [True, True, False, False]
    requests.ADDED_MODES.remove("red")
    assert not requests.validate_mask_mode(named).first().mode_ok


def test_blur_is_a_convolution():
    part = np.random.default_rng(1).integers(0, 256, (9, 14, 3)).astype(np.uint8)
    image = np.zeros((90, 120, 3), np.uint8)
    k = 45
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    want = part.astype(float)
    for axis in (0, 1):
        padded = np.pad(want, [(k // 2, k // 2) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        want = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="valid"), axis, padded)
    assert (images.MODES["blur"](image, part) == np.rint(want)).all()


def test_strokes_against_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ink = rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 14)))) < rng.choice([0.2, 0.45, 0.7])
        edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        if not len(y):
            continue
        got = signatures._components(pa.table({"image_id": [1] * len(y), "area_id": [0] * len(y), "y": y, "x1": start, "x2": end})).to_pandas()
        want, left = [], {tuple(p) for p in np.argwhere(ink)}
        while left:
            todo, part = [left.pop()], []
            while todo:
                a, b = todo.pop()
                part.append((a, b))
                near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*part, strict=True)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
        assert sorted(map(tuple, got[["x", "y", "w", "h", "size"]].to_numpy().tolist())) == sorted(want)


def test_ink_strokes_and_signature(spark, tmp_path):
    pixels = np.full((120, 200, 3), 255, np.uint8)
    for k in range(30):
        pixels[40 + k // 2, 30 + 2 * k : 34 + 2 * k] = 0
        pixels[70 - k // 2, 100 + 2 * k : 104 + 2 * k] = 0
    (tmp_path / "s.png").write_bytes(png(pixels))
    df = tables.read_images(spark, str(tmp_path), "*.png", decoded=True).select(F.lit(1).cast("bigint").alias("image_id"), "image")
    areas = spark.createDataFrame([(1, 0, 20, 30, 180, 90, 200, 120, "near_doctor")], "image_id bigint, area_id int, ax1 int, ay1 int, ax2 int, ay2 int, width int, height int, profile string")
    runs = signatures.ink_runs(df, areas)
    strokes = signatures.stroke_components(runs)
    assert strokes.count() == 2
    got = signatures.signature_regions(strokes, runs, areas).collect()
    assert len(got) == 1 and got[0].polygon[0][0] < 30 < got[0].polygon[1][0]


def test_engines_keep_going(spark):
    content = spark.createDataFrame([(1, b"x"), (2, b"bad")], "image_id bigint, content binary")

    def engine():
        def read(data):
            if data == b"bad":
                raise ValueError("cannot read")
            return {"rec_texts": ["李四"], "dt_polys": [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]], "rec_scores": [0.88]}

        return read

    got = engines.run_ocr(content, engine)
    assert [r.error for r in got.orderBy("image_id").collect()] == [None, "cannot read"]
    assert lines.normalize_ocr(got.where("error IS NULL")).first().text == "李四"
    asked = spark.createDataFrame([(1, "p", "q")], "image_id bigint, payload string, prompt string")
    assert engines.run_detector(asked, lambda: lambda payload, prompt: payload + prompt, 2).first().raw == "pq"


def test_masking_plan(spark, picture):
    pixels, df = picture
    ls = text_lines(spark, "报告医生：李四 ", "病历号：A123")
    found = detect.detect_rules(ls)
    row = detect.mask_batch(df, ls, found).first()
    assert row.masked and (as_pixels(row) != pixels).any()
    assert not detect.mask_batch(df, ls.limit(1), found).first().masked


def test_streams(spark, tmp_path):
    text_lines(spark, "报告医生：李四 ", "无").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINE).parquet(str(tmp_path / "in"))
    q = jobs.stream_detect(stream).writeStream.outputMode("append").format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.table("found").collect()] == ["李四"]
    log = spark.sql("SELECT id, timestamp_seconds(id * 400) AS ts, 'mask' AS endpoint, IF(id % 2 = 0, 'ok', 'error') AS status, double(id) AS elapsed_ms FROM range(6)")
    assert sum(r.n_ok for r in jobs.request_outcomes(log).collect()) == 3


def test_manifest_report_and_masked_files(spark, tmp_path):
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets/a.csv").write_text("row_num,url,note\n2, https://x/1 ,n\n3,ftp://x,n\n")
    (tmp_path / "sheets/~a.csv").write_text("row_num,url,note\n2,https://x/9,n\n")
    m = tables.read_manifest(spark, str(tmp_path / "sheets"))
    assert [(r.file, r.row_num, r.url, r.note) for r in m.collect()] == [("a.csv", 2, "https://x/1", "n")]
    stats = spark.createDataFrame([("https://x/1", 3, 9, "abc", True)], "url string, line_count int, char_count int, ocr_text string, has_text boolean")
    checked = batch.attach_results(m, stats)
    assert batch.batch_summary(checked).where("is_total = 1").first().has_text == 1
    tables.write_report(checked, str(tmp_path / "report"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "report")).first().has_text == "yes"
    df = spark.createDataFrame([("a/b_masked_1.png", bytearray(b"x")), ("c", bytearray(b"y"))], "derived_key string, content binary")
    tables.write_masked(df, str(tmp_path / "out"))
    assert {r.content_type for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"image/png", "application/octet-stream"}
    with pytest.raises(Exception, match="exists"):
        tables.write_masked(df, str(tmp_path / "out"))


def test_rect_is_clockwise(spark):
    assert spark.range(1).select(rect(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).first()[0] == [[1, 2], [3, 2], [3, 4], [1, 4]]


def test_answers_and_matches_are_computed_once(spark):
    """Filters that Spark derives don't parse, strip or match again (F15: wb_detect)."""
    answers = spark.createDataFrame([(1, '[{"line_index":0,"text":" 李四 ","category":"doctor"}]')], "image_id bigint, raw string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    parsed = plan(locate.parse_llm_items(answers))
    assert parsed.count("from_json(") + parsed.count("jsontostructs(") == 1
    assert parsed.count("parse_json(") + parsed.count("parsejson(") <= 1
    lined = spark.createDataFrame([(1, 0, "报告医生：李四 ", [[0, 0], [9, 0], [9, 9], [0, 9]], 0.9)], "image_id bigint, line_index int, text string, bbox array<array<int>>, confidence double")
    assert plan(rules.extract_values(lined)).count("regexp_extract_all(") == len(rules.RULES)
    assert [(r.text, r.line_index) for r in locate.parse_llm_items(answers).collect()] == [("李四", 0)]
    assert [r.value for r in rules.extract_values(lined).collect()] == ["李四"]
    twice = plan(regions.dedupe_twice(rules.rule_regions(lined), rules.rule_regions(lined)))
    assert twice.count("aggregate(") == 2  # one fold each
