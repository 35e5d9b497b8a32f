"""Ranked lexical search in reverse: the items' inverted index is broadcast, documents are streamed through it.

The items are the query set and the documents the large side, so the index is built over the items:
each of their terms has a posting list of item numbers. For each block of items documents are read once, in place:

1. Each document's terms are counted; its length and the counts of terms that some item holds are
   kept as one narrow row. Document frequencies are counted from these rows.
2. The rows are streamed through the index, whose terms now have weights. A few documents at a
   time become a small block of scores, and each item has a heap of its best documents so far in every
   task. Only the heaps leave a task; they are merged for each item.

Items are searched in blocks of a bounded size, so neither the driver nor a worker holds more than one
block of the index, whatever the number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, stored, utf8

TOP = 10
BLOCK_BYTES = 4 << 20  # text of one block of items
BLOCK_ITEMS = 20_000  # items of one block
CELLS = 1 << 16  # scores that are worked out at once, at least one document's
PIECE = 1 << 20  # bytes of a text that are split at once
MERGERS = 32  # tasks that merge one item's heaps before the last merge

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(_UPPER) | set(range(0x80, 0x100))
#: Bytes of UTF-8 in terms stand for themselves (A-Z in lower case), all others become a blank.
_TABLE = bytes(b + 32 if b in _UPPER else b if b in _LETTERS else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term stands in a text of any length."""
    found: Counter[bytes] = Counter()
    flat, at = text.translate(_TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


class ItemIndex:
    """Posting lists of a block of items: term k's items are items[start[k] : start[k + 1]]."""

    def __init__(self, terms: list[set[bytes]]):
        self.n_items = len(terms)
        self.number = {t: k for k, t in enumerate(sorted(set().union(*terms)))}
        pairs = [(self.number[t], i) for i, held in enumerate(terms) for t in held]
        pairs.sort()
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.items = both[:, 1].astype(np.int32)
        self.start = np.searchsorted(both[:, 0], np.arange(len(self.number) + 1))
        self.weight = np.zeros(len(self.number), dtype=np.int64)

    def weigh(self, n_docs: int, frequency: dict[int, int]) -> None:
        for k, df in frequency.items():
            self.weight[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of every item for every document (rows) from their counts; doc: the row of each count."""
        worth = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        n = self.start[term + 1] - self.start[term]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)
        out = np.zeros(len(m) * self.n_items, dtype=np.int64)
        np.add.at(out, np.repeat(doc, n) * self.n_items + self.items[at], np.repeat(worth, n))
        return out.reshape(len(m), self.n_items)


class Heaps:
    """The best documents of each item so far: at most `top` pairs of score and negated id, the worst first."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, dtype=np.int64)  # scores below can't enter a heap

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores: documents by items; documents without an id come after all others."""
        for row, item in zip(*np.nonzero((scores > 0) & (scores >= self.least)), strict=True):
            held, doc = self.heaps[item], ids[row]
            entry = (int(scores[row, item]), doc is not None, -(doc or 0))
            if len(held) < self.top:
                heapq.heappush(held, entry)
            else:
                heapq.heappushpop(held, entry)
            if len(held) == self.top:
                self.least[item] = held[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        """Item, document, score."""
        for item, held in enumerate(self.heaps):
            for score, known, negated in held:
                yield item, -negated if known else None, score


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[Any, set[bytes]]]]:
    """Items (id, terms) in blocks of bounded size; rows of one id are one item with all their terms."""
    known = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, n = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    count = int(size) // BLOCK_BYTES + n // BLOCK_ITEMS + 1
    numbered = known.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
    for k in range(count):
        held: dict[Any, set[bytes]] = {}
        for r in numbered.where(F.col("block") == k).toLocalIterator():
            held.setdefault(r["item"], set()).update(term_counts(r["text"].encode()))
        if any(held.values()):
            yield [(item, terms) for item, terms in held.items() if terms]


def count_item_terms(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the items' terms), tf: one row for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(index.number)

    def count(batches: Batches) -> Batches:
        number = sent.value
        for batch in batches:
            n, terms, tf = [], [], []
            for text in utf8(batch):
                found = term_counts(text)
                known = [(number[t], c) for t, c in found.items() if t in number]
                n.append(found.total())
                terms.append([k for k, _ in known])
                tf.append([c for _, c in known])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def _search_block(counts: DataFrame, block: list[tuple[Any, set[bytes]]], index: ItemIndex, top: int, item_type: str) -> DataFrame:
    """item_id, doc_id, score: the heaps of all tasks over the counted documents."""
    spark = counts.sparkSession
    n_docs, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most a row for each term of the block
    met = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    index.weigh(n_docs, {r["term"]: r["df"] for r in met.toLocalIterator()})
    sent = spark.sparkContext.broadcast(index)

    def search(batches: Batches) -> Batches:
        index = sent.value
        heaps, at_once = Heaps(index.n_items, top), max(1, CELLS // max(index.n_items, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                terms, tf = part.column("terms"), part.column("tf")
                doc = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                if len(doc):
                    m = np.array([100 - 90 + (90 * n * n_docs) // length for n in part.column("n").to_pylist()], dtype=np.int64)
                    scores = index.scores(doc, terms.flatten().to_numpy(), tf.flatten().to_numpy(), m)
                    heaps.add(scores, part.column("doc_id").to_pylist())
        found = list(heaps.rows())
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    heaps = counts.where("size(terms) > 0").mapInArrow(search, "item int, doc_id bigint, score bigint")
    ids = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"item int, item_id {item_type}")
    return heaps.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")  # a block's items are bounded


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` documents with the highest score above 0.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower
    case. Equal scores go by ascending doc_id, documents without an id last. Null texts
    have no terms and don't count; repeated rows of docs are documents of their own. Rows of
    one item_id (null: one item) are one item that holds the terms of all of them. Items
    without terms, and all items over an empty table, have no rows. Other columns aren't read.
    """
    item_type = dict(items.dtypes)[item_col]
    kept, found = id_and_text(docs, id_col, text_col), []
    for block in _blocks(items, item_col, item_text_col):
        index = ItemIndex([terms for _, terms in block])
        counts = stored(count_item_terms(kept, index), "term-counts")
        found.append(_search_block(counts, block, index, top, item_type))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    every = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGERS)))
    for keys in (["item_id", "part"], ["item_id"]):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    return every.select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL for the rows of op11.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d WHERE len(terms) > 0),
c AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM c GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, total WHERE term IN (SELECT term FROM i)),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN t USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
