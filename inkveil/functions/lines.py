"""OCR results as rows of lines, their boxes, and the sizes and faces of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import box_columns, rect

MAX_OCR_SIDE = 960  # longest side that recognition works on
ORIENTATION_ANGLES = {3: 180, 6: 90, 8: 270}  # fixed: clockwise degrees of EXIF orientations


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row.

    Exploded from an array of one element: Spark merges plain columns into each filter and column that
    uses them, and would parse an answer, or strip a text, again in all of these.
    """
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    return df.select("*", one).select(*df.columns, *[f"__once.{name}" for name in columns])


def normalize_ocr(ocr_raw: DataFrame) -> DataFrame:
    """text_lines from parallel arrays rec_texts, dt_polys, rec_scores or, where given, legacy array<struct<poly, text, conf>>.

    Blank texts and texts without a polygon are dropped, a missing score is 0. Lines are
    numbered then, and after that those with fewer than four points go, so numbers may
    have gaps. Points are rounded half to even.
    """
    zipped = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("rec_texts"), F.lit(1)) - 1),
        lambda i: F.struct(F.get("rec_texts", i).alias("text"), F.get("dt_polys", i).alias("poly"), F.coalesce(F.get("rec_scores", i), F.lit(0.0)).alias("score")),
    )
    if "legacy" in ocr_raw.columns:
        old = F.transform("legacy", lambda x: F.struct(x["text"].alias("text"), x["poly"].alias("poly"), F.coalesce(x["conf"], F.lit(0.0)).alias("score")))
        zipped = F.coalesce(F.when(F.col("rec_texts").isNull(), old), zipped)
    kept = F.filter(zipped, lambda x: F.coalesce(stripped(x["text"]) != "", F.lit(False)) & x["poly"].isNotNull())
    lines = ocr_raw.select("image_id", F.posexplode(kept).alias("line_index", "line"))
    points = F.transform("line.poly", lambda p: F.transform(p, lambda c: F.bround(c, 0).cast("int")))
    return lines.where(F.size("line.poly") >= 4).select("image_id", "line_index", F.col("line.text").alias("text"), points.alias("bbox"), F.col("line.score").alias("confidence"))


def rescale_bbox(text_lines: DataFrame, image_meta: DataFrame, max_side: int = MAX_OCR_SIDE) -> DataFrame:
    """Boxes found on an image shrunk to max_side, mapped back to its own size (cut off, not rounded)."""
    side = F.greatest("width", "height").cast("double")
    inverse = F.lit(1.0) / (F.lit(float(max_side)) / side)
    dims = image_meta.select("image_id", F.when(side > max_side, inverse).alias("__inverse"))
    scaled = F.transform("bbox", lambda p: F.transform(p, lambda c: (c * F.col("__inverse")).cast("int")))
    return text_lines.join(dims, "image_id").withColumn("bbox", F.when(F.col("__inverse").isNull(), F.col("bbox")).otherwise(scaled)).drop("__inverse")


def line_boxes(text_lines: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2 of the line's box."""
    return text_lines.select("*", *box_columns(F.col("bbox")))


def plan_vision_image(image_meta: DataFrame, max_side: int = 1280) -> DataFrame:
    """Adds sent_width, sent_height: shrunk, never enlarged, to max_side."""
    side = F.greatest("width", "height")
    scale = F.lit(float(max_side)) / side.cast("double")
    return image_meta.withColumns({f"sent_{k}": F.when(side > max_side, (F.col(k) * scale).cast("int")).otherwise(F.col(k)) for k in ("width", "height")})


def exif_angle(df: DataFrame, orientation_col: str = "exif_orientation") -> DataFrame:
    """Adds angle: clockwise degrees that set the image upright."""
    out = F.lit(0)
    for code, angle in ORIENTATION_ANGLES.items():
        out = F.when(F.col(orientation_col) == code, F.lit(angle)).otherwise(out)
    return df.withColumn("angle", out)


def filter_faces(faces: DataFrame, image_meta: DataFrame, ratio: float = 0.02) -> DataFrame:
    """x1..y2 of faces (x, y, w, h) with both sides of max(16, ratio of the shorter side), clipped, not empty."""
    least = F.greatest(F.lit(16), (F.least("width", "height").cast("double") * F.lit(ratio)).cast("int"))
    clipped = {"x1": F.greatest(F.lit(0), "x"), "y1": F.greatest(F.lit(0), "y"), "x2": F.least("width", F.col("x") + F.col("w")), "y2": F.least("height", F.col("y") + F.col("h"))}
    out = faces.join(image_meta.select("image_id", "width", "height"), "image_id").where((F.col("w") >= least) & (F.col("h") >= least))
    return out.withColumns(clipped).where("x2 > x1 AND y2 > y1")


def face_regions(faces: DataFrame) -> DataFrame:
    """Portrait regions of filtered faces: a fifth wider and three tenths higher on each side, clipped."""
    w = ((F.col("x2") - F.col("x1")).cast("double") * F.lit(0.20)).cast("int")
    h = ((F.col("y2") - F.col("y1")).cast("double") * F.lit(0.30)).cast("int")
    polygon = rect(F.greatest(F.lit(0), F.col("x1") - w), F.greatest(F.lit(0), F.col("y1") - h), F.least("width", F.col("x2") + w), F.least("height", F.col("y2") + h))
    seq = F.col("x").cast("long") * 100_000 + F.col("y")
    return faces.select("image_id", F.lit("face").alias("source"), seq.alias("seq"), F.lit("[人像]").alias("text"), F.lit("portrait").alias("category"), polygon.alias("polygon"), F.lit(-1).alias("ocr_line_index"))
