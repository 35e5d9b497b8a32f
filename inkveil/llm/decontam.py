"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of one task, bounded in words. Its words are mapped
to the benchmark's words; any other word can't be part of a match and separates
segments. The shard's index is a Burrows-Wheeler transform of the segments in a
wavelet tree, with sampled suffix positions. All test phrases (windows) are
searched backwards together: each step narrows every phrase's row interval by two
rank queries. Occurrences are located by walking to the next sampled row, and
their word ranges are merged into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, rows, stored, utf8

WINDOW = 10  # words of a test phrase
SHARD_WORDS = 1_500_000  # words of a shard; one longer document is a shard of its own
SAMPLE = 8  # every so many suffix positions are stored
BLOCK_BYTES = 4_000_000  # benchmark text of one block; each block is searched on its own
BLOCKS_AT_ONCE = 4  # blocks that are sent to the tasks of one pass over the documents

_SPANS = pa.list_(pa.list_(pa.int64()))

#: Fixed by the definition of a word: ASCII letters (lower-cased) and digits and all non-ASCII characters.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORD_BYTES).split()


class Phrases:
    """The windows of a block of benchmark items over a small alphabet of word ids (from 1)."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        pairs = []
        self.items = []
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                pairs.append((number.setdefault(tuple(ids[i : i + window]), len(number)), len(self.items)))
            self.items.append(item_id)
        self.length = np.array([len(p) for p in number], dtype=np.int64)
        self.shortest = int(self.length.min()) if number else 0
        self.words = np.zeros((len(number), window), dtype=np.int32)  # right-aligned
        for p, k in number.items():
            self.words[k, window - len(p) :] = p
        order = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)  # by phrase
        self.item_of, self.item_start = order[:, 1], np.searchsorted(order[:, 0], np.arange(len(number) + 1))


class WaveletTree:
    """Balanced wavelet matrix: one bit vector a level with ranks before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.bits, self.n = [], bits, len(symbols)
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for k, (packed, before, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._ones(packed, before, start), self._ones(packed, before, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for packed, before, zeros in self.levels:
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(packed, before, at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = (symbol << 1) | one
        return symbol


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order; every 0 of the text is a separator of its own, ordered by position.

    Prefix doubling: the first key packs as many symbols as fit in 62 bits, and each
    round sorts only the suffixes whose rank is still shared.
    """
    n = len(text)
    zero = np.flatnonzero(text == 0)
    # rank 0..k-1: the separators by place; words follow
    packed_to = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)  # no separator so far within the key
    for d in range(packed_to):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: max(0, n - d)] = text[d:]
        symbol[~alive] = 0
        alive &= symbol != 0
        key = (key << bits) | symbol
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    # a key with a separator inside is final: ties are ordered by place, as the stable sort left them
    final = (sorted_key & ((1 << bits) - 1)) == 0
    new |= final
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else rank
    rank[zero] = np.arange(len(zero))
    depth = packed_to
    head = np.flatnonzero(new) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    open_ = np.repeat(size > 1, size)
    while open_.any():
        at = np.flatnonzero(open_)
        who = order[at]
        # a shared key holds no separator, so that the suffix at +depth exists
        first, second = rank[who], rank[who + depth]
        by = np.lexsort((second, first))
        who, first, second = who[by], first[by], second[by]
        order[at] = who
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        size = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        open_ = np.zeros(n, dtype=bool)
        open_[at] = np.repeat(size > 1, size)
        depth *= 2
    return order


class FMIndex:
    """Over one shard: text holds word ids, 0 separates segments, the last symbol is 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n, bits = len(text), max(1, int(sigma).bit_length())
        order = suffix_array(text, bits)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = WaveletTree(last, bits)
        # rows kept: each SAMPLE-th position, and the first of each segment (no step leads over a separator)
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = np.packbits(np.append(kept, np.zeros(-self.n % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.kept_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64)])
        self.kept_position = order[kept]

    def intervals(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of every phrase, all searched together from their last word back."""
        count, width = phrases.words.shape
        lo, hi = np.zeros(count, dtype=np.int64), np.full(count, self.n, dtype=np.int64)
        for step in range(width):
            live = np.flatnonzero((phrases.length > step) & (lo < hi))
            if not len(live):
                break
            c = phrases.words[live, width - 1 - step]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a kept row."""
        position, todo, back = np.empty(len(row), dtype=np.int64), np.arange(len(row)), 0
        while len(todo):
            hit = (self.kept[row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1) == 1
            done = row[hit]
            position[todo[hit]] = back + self.kept_position[WaveletTree._ones(self.kept, self.kept_before, done)]
            todo, row, back = todo[~hit], row[~hit], back + 1
            if len(row):
                c = self.tree.get(row)
                row = self.first[c] + self.tree.rank(c, row)
        return position


Located = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def locate_shard(texts: list[list[bytes]], phrases: Phrases) -> Located | None:
    """Document number, first word, word after the last, and phrase number of every occurrence, by document and first word."""
    if not phrases.shortest:
        return None
    get, sizes = phrases.vocab.get, np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator follows each document
    ids = np.zeros(int(start[-1]) + 1, dtype=np.int64)
    for k, t in enumerate(texts):
        ids[start[k] : start[k] + len(t)] = [get(w, 0) for w in t]
    # segments: runs of benchmark words as long as the shortest phrase at least, each with one separator
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= phrases.shortest]
    if not len(runs):
        return None
    length = runs[:, 1] - runs[:, 0] + 1
    seg_start = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(int(seg_start[-1])) - np.repeat(seg_start[:-1] - runs[:, 0], length)
    text = ids[at]
    text[seg_start[1:] - 1] = 0
    index = FMIndex(text, len(phrases.vocab))
    lo, hi = index.intervals(phrases)
    count = hi - lo
    found = np.flatnonzero(count)
    if not len(found):
        return None
    count = count[found]
    phrase = np.repeat(found, count)
    row = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
    begin = at[index.locate(row)]
    end = begin + phrases.length[phrase]
    doc = np.searchsorted(start, begin, side="right") - 1
    by = np.lexsort((begin, doc))
    return doc[by], begin[by] - start[doc[by]], end[by] - start[doc[by]], phrase[by]


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    """For each document (as words): merged hit spans as an (n, 2) array of word ranges, and item numbers."""
    return _merged(len(texts), locate_shard(texts, phrases), phrases)


def _merged(n: int, located: Located | None, phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    out = [(np.zeros((0, 2), dtype=np.int64), set()) for _ in range(n)]
    if located is None:
        return out
    doc, begin, end, phrase = located
    cut = np.searchsorted(doc, np.arange(n + 1))
    for k in np.unique(doc):
        a, b, p = begin[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]], np.unique(phrase[cut[k] : cut[k + 1]])
        far = np.maximum.accumulate(b)
        new = np.flatnonzero(np.concatenate([[True], a[1:] > far[:-1]]))
        spans = np.stack([a[new], far[np.append(new[1:], len(a)) - 1]], axis=1)
        items = {int(i) for x in p for i in phrases.item_of[phrases.item_start[x] : phrases.item_start[x + 1]]}
        out[k] = (spans, items)
    return out


class _Passes:
    """The benchmark in passes of at most BLOCKS_AT_ONCE blocks of BLOCK_BYTES each.

    Its items are the query set: their total size is summed first, and the driver holds
    the items of one pass at a time, whatever the size of the benchmark.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int):
        self._context, self._window = docs.sparkSession.sparkContext, window
        self._items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
        size = self._items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self._blocks = int(size) // BLOCK_BYTES + 1
        self.count = -(-self._blocks // BLOCKS_AT_ONCE)

    def send(self, k: int) -> list[Broadcast]:
        """One broadcast for each block of a pass."""
        numbers = range(k * BLOCKS_AT_ONCE, min(self._blocks, (k + 1) * BLOCKS_AT_ONCE))
        block = F.pmod(F.xxhash64("item", "text"), F.lit(self._blocks)).cast("int")
        items: dict[int, list[tuple[str, bytes]]] = {n: [] for n in numbers}
        for r in self._items.select("item", "text", block.alias("block")).where(F.col("block").between(numbers[0], numbers[-1])).toLocalIterator():
            items[r["block"]].append((r["item"], r["text"].encode()))
        return [self._context.broadcast(Phrases(b, self._window)) for b in items.values()]


def _hits_of_texts(texts: DataFrame, passes: _Passes, window: int) -> DataFrame:
    """key, spans, items, whole of each different text with a hit, over all passes; texts: text.

    What a text holds depends on nothing but the text, so passes meet by its digest.
    """
    found = []
    for k in range(passes.count):
        blocks = passes.send(k)

        def search(batches: Batches, blocks: list[Broadcast] = blocks) -> Batches:
            for some, split in _shards(batches, "text"):
                hits = _search_all(split, [b.value for b in blocks], window)
                keys = [k for batch in some for k in batch.column("key").to_pylist()]
                kept = [(key, *h) for key, h in zip(keys, hits, strict=True) if h[0]]
                yield rows(dict(zip(("key", "spans", "items", "whole"), zip((pa.string(), _SPANS, pa.list_(pa.string()), pa.bool_()), zip(*kept, strict=True) if kept else ([],) * 4, strict=True), strict=True)))

        part = texts.select("text", F.md5("text").alias("key")).mapInArrow(search, "key string, spans array<array<bigint>>, items array<string>, whole boolean")
        found.append(stored(part.dropDuplicates(["key"]), "overlaps"))
        for b in blocks:
            b.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("whole").alias("whole"))

    def merge(batches: Batches) -> Batches:
        for batch in batches:
            spans = pa.array([_union(s) for s in batch.column("spans").to_pylist()], type=_SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("key"), spans, batch.column("items"), batch.column("whole")], names=["key", "spans", "items", "whole"])

    return every.mapInArrow(merge, "key string, spans array<array<bigint>>, items array<string>, whole boolean")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Benchmark passages in whole documents, one row per input row.

    Columns: doc_id, n_words, n_hit (words inside any occurrence), items (their ids
    as sorted strings), spans (merged hit ranges of word numbers, end exclusive).
    An item with fewer words than a window is one window; an item without words is
    none. Null and empty texts have no words; null item ids are not reported;
    repeated rows give a row each; an empty benchmark hits nothing; other columns are
    not read. Texts don't leave the task that reads them; only the benchmark's blocks
    are sent along. A benchmark of more than BLOCKS_AT_ONCE blocks is searched in several
    passes over the documents, whose hits are merged for each text.
    """
    passes = _Passes(docs, benchmark, item_col, item_text_col, window)
    kept = id_and_text(docs, id_col, text_col)
    if passes.count > 1:

        def count(batches: Batches) -> Batches:
            for batch in batches:
                yield rows({"doc_id": (pa.int64(), batch.column("doc_id")), "key": (pa.string(), batch.column("key")), "n_words": (pa.int64(), [len(words(d)) for d in utf8(batch)])})

        counted = kept.select("*", F.md5("text").alias("key")).mapInArrow(count, "doc_id bigint, key string, n_words bigint")
        met = counted.join(_hits_of_texts(kept, passes, window), "key", "left")
        n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0])
        return met.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"), F.coalesce("spans", F.expr("CAST(array() AS ARRAY<ARRAY<BIGINT>>)")).alias("spans"))
    blocks = passes.send(0)

    def search(batches: Batches) -> Batches:
        for some, texts in _shards(batches, "text"):
            found = _search_all(texts, [b.value for b in blocks], window)
            yield rows({
                "doc_id": (pa.int64(), [i for batch in some for i in batch.column("doc_id").to_pylist()]),
                "n_words": (pa.int64(), [len(t) for t in texts]),
                "n_hit": (pa.int64(), [sum(b - a for a, b in spans) for spans, _, _ in found]),
                "items": (pa.list_(pa.string()), [items for _, items, _ in found]),
                "spans": (_SPANS, [spans for spans, _, _ in found]),
            })

    return kept.mapInArrow(search, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<array<bigint>>")


def _shards(batches: Batches, text_col: str) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Runs of rows of about SHARD_WORDS words, with their texts as words."""
    some, texts, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            new = [words(d) for d in utf8(part, text_col)]
            more = sum(map(len, new))
            if texts and size + more > SHARD_WORDS:
                yield some, texts
                some, texts, size = [], [], 0
            some.append(part)
            texts += new
            size += more
    if texts:
        yield some, texts


def _union(spans: Iterable[Sequence[int]]) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _search_all(texts: list[list[bytes]], blocks: list[Phrases], window: int) -> list[tuple[list[list[int]], list[str], bool]]:
    """Merged spans, sorted item ids, and whether a full window occurs, of each text over all blocks."""
    hits: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    whole = np.zeros(len(texts), dtype=bool)
    for phrases in blocks:
        located = locate_shard(texts, phrases)
        if located is None:
            continue
        whole[located[0][phrases.length[located[3]] >= window]] = True
        for k, (spans, numbers) in enumerate(_merged(len(texts), located, phrases)):
            hits[k] += spans.tolist()
            items[k] |= {phrases.items[i] for i in numbers} - {None}
    return [(_union(spans), sorted(found), bool(w)) for spans, found, w in zip(hits, items, whole, strict=True)]


def cut_words(data: bytes, spans: Sequence[Sequence[int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORD_BYTES))]
    out, end = [], 0
    for a, b in spans:
        out.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, data[end:]])


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without benchmark passages, with all input columns.

    A document that holds a full window of an item goes; occurrences of shorter items,
    touching ones too, are cut out of the text. All other rows stay as they are: null and
    empty texts, texts of any length, and repeated rows each. An empty table gives an
    empty table, an empty benchmark takes nothing.
    """
    passes = _Passes(docs, benchmark, item_col, item_text_col, window)

    def cleaned(batch: pa.RecordBatch, spans: list, whole: list) -> pa.RecordBatch:
        at, data = batch.schema.get_field_index(text_col), utf8(batch, text_col)
        cut = [cut_words(d, s).decode() if s else None if d is None else d.decode() for d, s in zip(data, spans, strict=True)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(cut, type=batch.schema.field(at).type))
        return batch.filter(pa.array([not w for w in whole], type=pa.bool_()))

    if passes.count > 1:
        hits = _hits_of_texts(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), passes, window)
        named = hits.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"), F.col("whole").alias("__whole"))
        met = docs.join(named, F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__key"), "left").drop("__key")

        def cut(batches: Batches) -> Batches:
            for batch in batches:
                yield cleaned(batch.select(docs_columns), batch.column("__spans").to_pylist(), batch.column("__whole").to_pylist())

        docs_columns = docs.columns
        return met.mapInArrow(cut, docs.schema)
    blocks = passes.send(0)

    def clean(batches: Batches) -> Batches:
        for some, texts in _shards(batches, text_col):
            found = iter(_search_all(texts, [b.value for b in blocks], window))
            for batch in some:
                spans, _, whole = zip(*(next(found) for _ in range(batch.num_rows)), strict=True) if batch.num_rows else ((), (), ())
                yield cleaned(batch, spans, whole)

    return docs.mapInArrow(clean, docs.schema)
