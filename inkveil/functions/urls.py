"""Object URLs, keys, extensions and file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host patterns of object URLs, supported extensions, file signatures, media types.
HOST_PATTERN = r"^(.+)\.cos\.([^.]+)\.(myqcloud\.com|tencentcos\.cn)$"
STANDARD_HOST = "myqcloud.com"
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif")
SIGNATURES = (("FFD8FF", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("424D", "BMP"), ("52494646", "WEBP"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"))
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp", ".webp": "image/webp", ".tiff": "image/tiff"}
DEFAULT_MEDIA_TYPE = "image/jpeg"
MEDIA_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/bmp": ".bmp", "image/webp": ".webp", "image/gif": ".gif", "image/tiff": ".tiff"}
KNOWN_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif", ".tiff")


def suffix(path: Column) -> Column:
    """Last extension of the last path segment with its dot; empty if it has none or only a leading dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1)


def parse_object_url(df: DataFrame, url_col: str = "url", domain_map: DataFrame | None = None) -> DataFrame:
    """Adds bucket, region, key and url_error (null if the URL is understood).

    Standard hosts carry bucket and region; other hosts are looked up in domain_map
    (domain, bucket, region), a configuration table that Spark joins as its size allows.
    Keys are percent-decoded ("+" stays), without leading slashes and query.
    """
    url = F.col(url_col)
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+", "")
    key = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = df.withColumns({"__host": host, "key": key, "bucket": F.nullif(F.regexp_extract(host, HOST_PATTERN, 1), F.lit("")), "region": F.nullif(F.regexp_extract(host, HOST_PATTERN, 2), F.lit(""))})
    if domain_map is not None:
        known = domain_map.groupBy(F.lower("domain").alias("__domain")).agg(F.max_by("bucket", "ordinal").alias("__bucket"), F.max_by("region", "ordinal").alias("__region"))
        out = out.join(known, out["__host"] == known["__domain"], "left")
        out = out.withColumns({"bucket": F.coalesce("bucket", "__bucket"), "region": F.coalesce("region", "__region")}).drop("__domain", "__bucket", "__region")
    understood = F.col("bucket").isNotNull()
    return out.withColumns({"key": F.when(understood, F.col("key")), "url_error": F.when(~understood, F.lit("unknown host"))}).drop("__host")


def build_object_url(df: DataFrame, domain_map: DataFrame | None = None, scheme: str = "https") -> DataFrame:
    """Adds object_url from bucket, region, key; the first domain of that bucket and region wins over the standard host."""
    standard = F.concat("bucket", F.lit(".cos."), "region", F.lit(f".{STANDARD_HOST}"))
    if domain_map is None:
        return df.withColumn("object_url", F.concat(F.lit(f"{scheme}://"), standard, F.lit("/"), "key"))
    first = domain_map.groupBy(F.col("bucket").alias("__b"), F.col("region").alias("__r")).agg(F.min_by("domain", "ordinal").alias("__domain"))
    out = df.join(first, (F.col("bucket") == F.col("__b")) & (F.col("region") == F.col("__r")), "left")
    return out.withColumn("object_url", F.concat(F.lit(f"{scheme}://"), F.coalesce("__domain", standard), F.lit("/"), "key")).drop("__b", "__r", "__domain")


def derive_key(df: DataFrame, kind: str, ts: Column | int | None = None, key_col: str = "key") -> DataFrame:
    """Adds derived_key: `_masked_<ts>`, `_bak_<ts>` or `_masked_vision` before the last extension of the last segment."""
    key = F.regexp_replace(F.col(key_col), "/+$", "")
    mark = {"masked": "_masked_", "backup": "_bak_", "local": "_masked_vision"}[kind]
    tail = F.lit(mark) if kind == "local" else F.concat(F.lit(mark), (ts if isinstance(ts, Column) else F.lit(ts)).cast("string"))
    ext = suffix(key)
    return df.withColumn("derived_key", F.concat(F.substr(key, F.lit(1), F.length(key) - F.length(ext)), tail, ext))


def filter_supported_ext(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ext and ext_ok: the extension of what stands before "?", lower-cased; none at all passes."""
    ext = F.lower(suffix(F.substring_index(F.col(url_col), "?", 1)))
    return df.withColumns({"ext": ext, "ext_ok": (ext == "") | ext.isin(*EXTENSIONS)})


def sniff_format(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds format (null if unknown) and format_error from the first 16 bytes."""
    head = F.hex(F.substring(F.col(content_col), 1, 16))
    found = F.lit(None).cast("string")
    for signature, name in reversed(SIGNATURES):
        found = F.when(head.startswith(signature), F.lit(name)).otherwise(found)
    empty = F.coalesce(F.length(head), F.lit(0)) < 4
    error = F.when(empty, F.lit("empty")).when(found.isNull(), F.concat(F.lit("unknown format "), F.substring(head, 1, 16)))
    return df.withColumns({"format": F.when(~empty, found), "format_error": error})


def media_type(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds media_type by extension; unknown ones get the default."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return df.withColumn("media_type", F.coalesce(F.try_element_at(table, F.lower(suffix(F.col(path_col)))), F.lit(DEFAULT_MEDIA_TYPE)))


def suffix_or_default(df: DataFrame, path_col: str = "path", content_type_col: str | None = None, default: str = ".jpg") -> DataFrame:
    """Adds suffix: the path's own if it is known, else by content type (parameters cut off), else the default."""
    own = F.lower(suffix(F.col(path_col)))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_EXTENSIONS.items() for x in pair])
    by_type = F.lit(None).cast("string") if content_type_col is None else F.try_element_at(table, F.lower(F.trim(F.substring_index(F.col(content_type_col), ";", 1))))
    return df.withColumn("suffix", F.when(own.isin(*KNOWN_SUFFIXES), own).otherwise(F.coalesce(by_type, F.lit(default))))
