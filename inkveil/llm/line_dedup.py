"""Lines that many documents share go: lines are exploded, hashed and counted by document, in DataFrame functions only.

A line's key is the line without blanks at its ends and with A-Z in lower case. Its 128-bit hash
stands for it: a document's different hashes are exploded, and documents are counted for each hash.
The hashes over the threshold are written first, so that Spark splits the lines' side of the join where
one hash is hot; lines with an empty key never take part. Only places of dropped lines go back to their document,
whose text is cut there and put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import id_and_text, stored

MIN_DOCUMENTS = 10  # documents that hold a key, from which its lines go
MIN_CHARS = 1  # code points of a key, from which its lines can go
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*columns: Column) -> Column:
    """struct<a: bigint, b: bigint> of two differently seeded hashes."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, ra, rb (the row's hash), place, ha, hb: one row for each line whose key has min_chars code points.

    docs: doc_id, text (not null).
    """
    row = hash128(F.col("doc_id"), F.col("text"))
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    lines = docs.select("doc_id", row["a"].alias("ra"), row["b"].alias("rb"), F.posexplode(keys).alias("place", "key"))
    h = hash128(F.col("key"))
    return lines.where(F.length("key") >= max(min_chars, 1)).select("doc_id", "ra", "rb", "place", h["a"].alias("ha"), h["b"].alias("hb"))


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """ha, hb, n_docs of the keys that at least min_documents documents hold; lines as of line_hashes.

    Pairs of hash and document are made distinct first, dealt by both, so that a hot line is counted
    by many tasks. Rows of one doc_id are one document; so are all rows without one.
    """
    pairs = lines.select("ha", "hb", "doc_id").distinct()
    return pairs.groupBy("ha", "hb").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_documents)


def without(lines: Column, places: Column) -> Column:
    """The lines whose places (ascending, from 0) aren't named, put together; work grows with both, not with their product."""
    # one-element arrays bind what is used more than once
    both = F.array(F.struct(lines.alias("lines"), places.alias("places")))

    def cut(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(x["places"], lambda p: p + 1))
        ends = F.concat(x["places"], F.array(F.size(x["lines"])))
        pieces = F.zip_with(starts, ends, lambda a, b: F.slice(x["lines"], a + 1, b - a))
        return F.array_join(F.flatten(pieces), "\n")

    return F.transform(both, cut)[0]


def drop_shared_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is kept), n_lines (before), n_dropped; one row for each row of docs.

    Lines whose key has min_chars code points and stands in min_documents documents go from every
    document. Null and empty texts are one empty line. Rows of one doc_id, repeated or different,
    count as one document; so do all rows with a null id. Equal rows give equal rows each. An
    empty table gives an empty table. Other columns are not read. A document that loses all lines
    keeps an empty text.
    """
    kept = id_and_text(docs, id_col, text_col)
    lines = line_hashes(kept, min_chars)
    shared = stored(shared_lines(lines, min_documents), "shared-lines")
    gone = lines.select("ra", "rb", "place", "ha", "hb").join(shared.select("ha", "hb"), ["ha", "hb"], "left_semi")
    # equal rows share one hash and so one set of places
    places = gone.groupBy("ra", "rb").agg(F.array_sort(F.collect_set("place")).alias("places"))
    row = hash128(F.col("doc_id"), F.col("text"))
    met = kept.withColumns({"ra": row["a"], "rb": row["b"]}).join(places, ["ra", "rb"], "left")
    split = F.split("text", "\n")
    return met.select(
        "doc_id",
        F.when(F.col("places").isNull(), F.col("text")).otherwise(without(split, F.col("places"))).alias("text"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


#: DuckDB SQL for the rows of op13.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (shared.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY doc_id
"""
