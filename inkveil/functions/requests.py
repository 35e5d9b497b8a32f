"""Request defaults, mode checks, error classes, prompts and model payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default categories, mask modes, markers of an overloaded engine.
DEFAULT_CATEGORIES = ("name", "id_card", "phone", "medical_id", "doctor", "email", "address", "hospital", "portrait")
MASK_MODES = ("black", "gray", "white", "blur", "mosaic")
DEFAULT_MODE = "white"
OVERLOAD_MARKERS = ("out of memory", "resourceexhausted", "cannot allocate", "cublas_status", "cudnn_status")

#: What a category means, in words of our own; callers pass their own texts for their model.
DESCRIPTIONS = {
    "name": "names of people other than staff",
    "id_card": "identity card numbers of 15 or 18 digits",
    "phone": "telephone numbers",
    "medical_id": "record, visit and sample numbers",
    "doctor": "names of medical staff",
    "email": "e-mail addresses",
    "address": "private addresses",
    "hospital": "names of hospitals and clinics",
    "portrait": "photographs of people",
    "age": "ages",
    "date": "dates of any kind",
    "date_of_birth": "dates of birth",
}


def apply_request_defaults(df: DataFrame, default_provider: str, default_mode: str = DEFAULT_MODE) -> DataFrame:
    """Fills llm_provider (empty counts as missing), mask_mode and categories."""
    return df.withColumns({
        "llm_provider": F.coalesce(F.nullif("llm_provider", F.lit("")), F.lit(default_provider)),
        "mask_mode": F.coalesce("mask_mode", F.lit(default_mode)),
        "categories": F.coalesce("categories", F.array(*map(F.lit, DEFAULT_CATEGORIES))),
    })


ADDED_MODES: list[str] = []  # by images.register_mask_mode


def validate_mask_mode(df: DataFrame, modes: tuple[str, ...] | None = None) -> DataFrame:
    """Adds mode_ok: one of the fixed or added modes, or of those given; a null mode isn't one."""
    known = (*MASK_MODES, *ADDED_MODES) if modes is None else modes
    return df.withColumn("mode_ok", F.coalesce(F.col("mask_mode").isin(*known), F.lit(False)))


def classify_errors(df: DataFrame, msg_col: str = "message") -> DataFrame:
    """Adds outcome: ok (no message), overload (holds a marker in any case) or error."""
    lower, overload = F.lower(F.col(msg_col)), F.lit(False)
    for marker in OVERLOAD_MARKERS:
        overload = overload | lower.contains(marker)
    return df.withColumn("outcome", F.when(F.col(msg_col).isNull(), "ok").when(overload, "overload").otherwise("error"))


def category_prompt(df: DataFrame, descriptions: dict[str, str] | None = None, template: str = "Find these kinds of values:\n{list}", no_dates: str = "\nLeave out dates.") -> DataFrame:
    """Adds prompt: the numbered categories; an unknown one describes itself; dates are ruled out unless asked for."""
    known = DESCRIPTIONS if descriptions is None else descriptions
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    numbered = F.transform("categories", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c, F.lit(": "), F.coalesce(F.try_element_at(table, c), c)))
    before, _, after = template.partition("{list}")
    switch = F.when(F.array_contains("categories", "date"), F.lit("")).otherwise(F.lit(no_dates))
    return df.withColumn("prompt", F.concat(F.lit(before), F.array_join(numbered, "\n"), F.lit(after), switch))


def vision_requests(images: DataFrame, text_lines: DataFrame, requests: DataFrame) -> DataFrame:
    """image_id, lines_json, prompt, media_type, payload (base64 without line breaks): one row per request.

    images: image_id, content BINARY, media_type. Lines are grouped before the join, and
    the payload is encoded last, so bytes pass one exchange at most.
    """
    lines = text_lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_index").alias("index"), "text"))).alias("lines"))
    out = requests.join(lines, "image_id", "left").join(images.select("image_id", "content", "media_type"), "image_id")
    empty = F.lit("[]")
    payload = F.regexp_replace(F.base64("content"), "[\r\n]", "")
    return out.select("image_id", F.coalesce(F.to_json("lines"), empty).alias("lines_json"), "prompt", "media_type", payload.alias("payload"))
