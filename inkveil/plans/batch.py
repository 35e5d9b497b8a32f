"""The text check of image batches: manifest in, report out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.lines import ocr_text_check
from inkveil.sources.staging import staged

KEYS = ("file", "row_num")


def attach_results(manifest: DataFrame, text_stats: DataFrame, errors: DataFrame | None = None, on: str = "url") -> DataFrame:
    """Every manifest row with its image's line_count, char_count, ocr_text, has_text and error.

    Images without lines, or whose download failed (errors: url, error), get zeros. Several
    rows may name the same image.
    """
    out = manifest.join(text_stats, on, "left")
    out = out.join(errors, on, "left") if errors is not None else out.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("error").isNotNull()
    return out.withColumns({
        "line_count": F.when(failed, 0).otherwise(F.coalesce("line_count", F.lit(0))),
        "char_count": F.when(failed, 0).otherwise(F.coalesce("char_count", F.lit(0))),
        "ocr_text": F.when(failed, "").otherwise(F.coalesce("ocr_text", F.lit(""))),
        "has_text": ~failed & F.coalesce("has_text", F.lit(False)),
    })


def batch_summary(ocr_check: DataFrame, elapsed_col: str | None = None) -> DataFrame:
    """Per file and in all (file null): total, has_text, no_text, error (an error wins), and images_per_s if times are known."""
    failed = F.col("error").isNotNull()
    aggregates = [F.count("*").alias("total"), F.count_if(~failed & F.col("has_text")).alias("has_text"), F.count_if(~failed & ~F.col("has_text")).alias("no_text"), F.count_if(failed).alias("error")]
    if elapsed_col:
        total = F.sum(elapsed_col)
        aggregates.append(F.when(total > 0, F.count("*").cast("double") / total).alias("images_per_s"))
    return ocr_check.rollup("file").agg(F.grouping("file").cast("int").alias("is_total"), *aggregates)


def rows_with_text(manifest: DataFrame, ocr_check: DataFrame) -> DataFrame:
    """Manifest rows whose image has text, by file and row."""
    return manifest.join(ocr_check.where(F.col("error").isNull() & F.col("has_text")), list(KEYS), "left_semi").orderBy(*KEYS)


def stage_latency(stage_metrics: DataFrame, stages: tuple[str, ...] = ("orientation_ms", "ocr_ms", "rotation_retry_ms", "detect_ms", "mask_ms"), exact: bool = False) -> DataFrame:
    """stage, images, avg_ms, p50_ms, p95_ms, max_ms, share (of all stages' time); exact percentiles on wish."""
    stack = ", ".join(f"'{s}', {s}" for s in stages)
    long = stage_metrics.selectExpr(f"stack({len(stages)}, {stack}) AS (stage, ms)").where("ms IS NOT NULL")
    sums = [F.count("*").alias("images"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), F.sum("ms").alias("__sum")]
    asked = {"p50_ms": 0.5, "p95_ms": 0.95}
    if exact:
        out = long.groupBy("stage").agg(*sums).join(exact_percentiles(long, "stage", "ms", asked), "stage")
    else:
        out = long.groupBy("stage").agg(*sums, *[F.percentile_approx("ms", q, 10_000).alias(p) for p, q in asked.items()])
    whole = F.sum("__sum").over(Window.partitionBy())  # over a row for each stage
    return out.select("stage", "images", "avg_ms", "p50_ms", "p95_ms", "max_ms", (F.col("__sum") / whole).alias("share"))


def exact_percentiles(values: DataFrame, key: str, value: str, asked: dict[str, float]) -> DataFrame:
    """key and a column for each of asked (name: fraction): exact percentiles, between two values in proportion, of any number of values.

    Equal values are counted first. The counts are dealt by ranges, so that a key's values are spread
    over tasks; how many stand before each range tells in which one a rank is, and only
    those ranges are counted through.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    ranged = staged(counted.repartitionByRange(RANGES, key, value).withColumn("part", F.spark_partition_id()), "ranges")
    by_part = Window.partitionBy(key).orderBy("part")
    parts = ranged.groupBy(key, "part").agg(F.sum("n").alias("size"))  # a row for each range
    parts = parts.select(key, "part", "size", (F.sum("size").over(by_part) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(key)).alias("total"))
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("name"), ((F.col("total") - 1) * F.lit(q)).alias("at")) for p, q in asked.items()]))
    ranks = parts.select(key, "part", "size", "before", ranks.alias("r")).select(key, "part", "size", "before", "r.*")
    reached = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("size"))
    ranks = ranks.where(reached(F.floor("at")) | reached(F.ceil("at"))).select(key, "part", "before", "name", "at")
    inside = ranged.join(ranks.select(key, "part").distinct(), [key, "part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("upto", upto).join(ranks, [key, "part"]).withColumns({"first": F.col("before") + F.col("upto") - F.col("n"), "last": F.col("before") + F.col("upto") - 1})
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col(value)))
    found = placed.groupBy(key, "name", "at").agg(at(F.floor("at")).alias("low"), at(F.ceil("at")).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == p, between)).alias(p) for p in asked])


RANGES = 200  # that the values of all keys are dealt to
STAGES = ("orientation_ms", "ocr_ms", "rotation_retry_ms", "detect_ms", "mask_ms")
SKETCH_SIZE = 800  # of a quantile sketch; its ranks are off by less than half a percent, after merging too


def latency_sketches(stage_metrics: DataFrame, day_col: str = "day", stages: tuple[str, ...] = STAGES) -> DataFrame:
    """day, stage, images, sum_ms, max_ms, sketch (quantiles): small rows that are kept for each day and added up later."""
    stack = ", ".join(f"'{s}', {s}" for s in stages)
    long = stage_metrics.selectExpr(f"{day_col} AS day", f"stack({len(stages)}, {stack}) AS (stage, ms)").where("ms IS NOT NULL")
    return long.groupBy("day", "stage").agg(F.count("*").alias("images"), F.sum("ms").alias("sum_ms"), F.max("ms").alias("max_ms"), F.kll_sketch_agg_double("ms", SKETCH_SIZE).alias("sketch"))


def latency_of_days(sketches: DataFrame) -> DataFrame:
    """stage, images, avg_ms, p50_ms, p95_ms, max_ms, share over the days given; times themselves are not read again."""
    out = sketches.groupBy("stage").agg(F.sum("images").alias("images"), F.sum("sum_ms").alias("__sum"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("__all"))
    at = lambda q: F.kll_sketch_get_quantile_double("__all", F.lit(q))
    whole = F.sum("__sum").over(Window.partitionBy())  # over a row for each stage
    return out.select("stage", "images", (F.col("__sum") / F.col("images")).alias("avg_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), "max_ms", (F.col("__sum") / whole).alias("share"))


def text_check(manifest: DataFrame, text_lines: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The whole check: statistics per image, joined to every manifest row (manifest: image_id, file, row_num, url)."""
    return attach_results(manifest, ocr_text_check(text_lines), errors, on="image_id")
