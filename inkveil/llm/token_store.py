"""Token ids in binary shards with a minimal perfect hash index.

A shard is one run of documents in ascending doc_id order: raw little-endian 32-bit
ids, their offsets, and an index from document key to place. The index is a cascade
of bit maps: at each level the keys that hash to a position of their own set its
bit, the others go on to the next level; the rank of a key's bit is its place among
0..n-1, so no slot is empty. A stored fingerprint for each place rejects keys that
the shard doesn't hold. A lookup costs a few hashes and one rank, whatever the size.

Shards are rows of a Parquet table (one binary column for each part), so that any
storage Spark can write to holds them and a lost task's half-written shard never
becomes visible. `Shard.parse` reads the same bytes from anywhere.

Layout of a shard's bytes, all numbers little-endian:
magic "IVTS1\\0\\0\\0", n documents (u64), n ids (u64), index length (u64);
offsets u64[n+1]; keys' order u32[n] (place -> document); fingerprints u32[n];
index; ids u32[n ids].
"""

from __future__ import annotations

import gc
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, fresh_path, id_and_text, partitions, rows

MAGIC = b"IVTS1\0\0\0"
END_ID = 0  # appended to each document
SHARD_IDS = 100_000  # ids after which a shard is closed; a longer document is a shard of its own
#: Shards are long values: a row group is decoded as a whole, so it's closed at 16 MB, which is looked at every few rows.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4}
GAMMA = 1.5  # bits of a level for each key
NULL_KEY = -(2**63)  # the key of a null doc_id

CACHE_WORDS = 400_000  # words of a generation; a worker remembers the ids of two
LONG_WORD = 64  # characters over which a word isn't remembered
LETTERS_BELOW = 0x250  # letters under this code point are letters to every version of Unicode that has them
LAST_LETTER = chr(LETTERS_BELOW)
MARKS = ".,;:!?%$&#*|"  # what may be split off a word's end

_ENCODERS: dict[str, WordwiseEncoder] = {}


class WordwiseEncoder:
    """Ids of whole texts from the tokenizers library, each distinct word encoded once.

    The byte-level pre-tokenizer always cuts before a space or line break that stands
    between two other characters, so the ids of a text are those of its words in turn.
    Texts with any other white space, or with the string of a special token, are
    encoded whole. A word of letters alone is one pre-token with the space before it,
    so the library's model gets it directly; other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        # a task has one core; the library's own threads would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # the character that stands for each byte in the vocabulary, from the library
        signs = [ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(LETTERS_BELOW)]
        self._sign = {c: x for c, x in enumerate(signs)}
        self._marks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._after_space: dict[str, bytes] = {}  # word -> ids after a space; with a leading line break: as it stands

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in (e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words after a space, or as they stand if they begin with a line break."""
        split = self._tokenizer.model.tokenize
        sign, rest = self._sign, []
        blank = sign[ord(" ")]
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) < LAST_LETTER):
                ids = [t.id for t in split(blank + (w if w.isascii() else w.translate(sign)))]  # ASCII letters stand for themselves
                yield w, array("I", ids).tobytes()
            elif w[:1] == "\n" and w[1:].isalpha() and max(w) < LAST_LETTER:  # a line break before letters is a pre-token of its own
                ids = [t.id for part in ("\n", w[1:]) for t in split(part.translate(sign))]
                yield w, array("I", ids).tobytes()
            else:
                rest.append(w)
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            yield from zip(some, self._encode([w if w[:1] == "\n" else " " + w for w in some]), strict=True)

    def _learn(self, new: Iterable[str]) -> None:
        """Remember the ids of new words; marks at a word's end are pre-tokens of their own, and so are looked up apart."""
        known, old, marks = self._after_space, self._older, self._marks
        ends, whole, unmarked = [], set(), set()
        for w in new:
            ids = old.get(w)
            if ids is not None:
                known[w] = ids
                continue
            stem = w.rstrip(MARKS)
            if len(stem) == len(w) or not stem or not stem[-1].isalnum():
                whole.add(w)
                continue
            mark = w[len(stem) :]
            ends.append((w, stem, mark))
            if mark not in marks:
                unmarked.add(mark)
            if stem not in known:
                ids = old.get(stem)
                if ids is None:
                    whole.add(stem)
                else:
                    known[stem] = ids
        known.update(self._encode_words(list(whole)))
        missing = list(unmarked)
        marks.update(zip(missing, self._encode(missing), strict=True))
        for w, stem, mark in ends:
            known[w] = known[stem] + marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        if len(self._after_space) > CACHE_WORDS:  # words in use move on to the new generation, the rest is forgotten with the next one
            self._older, self._after_space = self._after_space, {}
            self._marks.clear()
        known = self._after_space
        cut, whole, new = {}, [], set()
        for k, text in enumerate(texts):
            if not text:
                continue
            words = text.replace("\n", " \n").split(" ")
            # single blanks and line breaks between words, and no other white space, which isn't printable
            if "" in words or "\n" in words or not text.replace("\n", "").isprintable() or any(x in text for x in self._special):
                whole.append(k)
                continue
            ids = list(map(known.get, words))
            cut[k] = words, ids
            if None in ids:
                new.update(w for w, i in zip(words, ids, strict=True) if i is None)
        self._learn(new)
        first = self._encode([words[0] for words, _ in cut.values()])
        for (k, (words, ids)), head in zip(cut.items(), first, strict=True):
            ids[0] = head
            if None in ids:
                ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
            out[k] = b"".join(ids)
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids
        for w in new:
            if len(w) > LONG_WORD:  # so that the memory of words is bounded in bytes
                for x in (w, w.rstrip(MARKS)):
                    known.pop(x, None)
                self._marks.clear()
        return out


def encoder(path: str) -> WordwiseEncoder:
    """The encoder of a file, loaded once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordwiseEncoder(path)
    return _ENCODERS[path]


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of integer keys (splitmix64's finaliser), differing by seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        sizes, levels, left = [], [], keys.view(np.uint64)
        while len(left):
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bit = np.zeros(size, dtype=np.uint8)
            bit[at[alone]] = 1
            levels.append(np.packbits(bit, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 where no level has the key's bit (a foreign key can get a place too)."""
        keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.base[level]
            word, shift = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.sizes)) + np.array(self.sizes, "<i8").tobytes() + self.bits.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview | bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<q", data)
        return cls(np.frombuffer(data, "<i8", n, 8).tolist(), np.frombuffer(data, "<u8", offset=8 + 8 * n).astype(np.uint64))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys, dtype=np.int64).view(np.uint64), 10_007) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Read access to a shard's bytes."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, order: np.ndarray, prints: np.ndarray, index: PerfectHash, ids: np.ndarray):
        self.keys, self.offsets, self.order, self.prints, self.index, self.ids = keys, offsets, order, prints, index, ids

    @staticmethod
    def pack(keys: np.ndarray, documents: list[bytes]) -> bytes:
        """documents: each one's ids as bytes. keys ascending; of equal keys the index holds the first, the others follow it."""
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        index = PerfectHash.build(keys[first])
        place = index.place(keys[first])
        order, prints = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")
        order[place], prints[place] = first, _fingerprint(keys[first])
        offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in documents])]).astype("<u8")
        packed = index.to_bytes()
        head = MAGIC + struct.pack("<QQQQ", len(keys), len(first), int(offsets[-1]), len(packed))
        return b"".join([head, keys.astype("<i8").tobytes(), offsets.tobytes(), order.tobytes(), prints.tobytes(), packed, *documents])

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, distinct, n_ids, length = struct.unpack_from("<QQQQ", view, 8)
        keys = np.frombuffer(view, "<i8", n, 40)
        at = 40 + 8 * n
        offsets = np.frombuffer(view, "<u8", n + 1, at)
        at += 8 * (n + 1)
        order = np.frombuffer(view, "<u4", distinct, at)
        prints = np.frombuffer(view, "<u4", distinct, at + 4 * distinct)
        at += 8 * distinct
        return cls(keys, offsets, order, prints, PerfectHash.from_bytes(view[at : at + length]), np.frombuffer(view, "<u4", n_ids, at + length))

    def document(self, k: int) -> np.ndarray:
        return self.ids[int(self.offsets[k]) : int(self.offsets[k + 1])]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Document numbers of keys within the shard, -1 for keys it doesn't hold."""
        keys = np.asarray(keys, dtype=np.int64)
        place = self.index.place(keys)
        known = place >= 0
        known[known] = self.prints[place[known]] == _fingerprint(keys[known])
        out = np.full(len(keys), -1, dtype=np.int64)
        out[known] = self.order[place[known]]
        return out


SHARDS = "part int, number int, earlier bigint, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, shard binary"


def write_shards(
    docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, buckets: int | None = None
) -> None:
    """Encode whole texts and write them as shards in ascending doc_id order.

    Null texts are empty (one end id). Null ids come first, under a key of their own;
    repeated ids follow each other by their texts' hashes. Special tokens' strings in a text become
    their ids, as the library does by default. Rows are dealt by ranges of doc_id, so
    each task writes a contiguous run and no shard spans two tasks; an empty table
    writes no shard. Other columns are not read. With `buckets`, files are bucketed by
    part, so that readers who know the number needn't shuffle shards.
    """

    def encode(batches: Batches) -> Batches:
        tokenizer, end = encoder(vocabulary), struct.pack("<I", end_id)
        gc.disable()  # nothing here is cyclic; the collector would only look through the remembered words again and again
        part, number, earlier, size, keys, documents = 0, 0, 0, 0, [], []

        def closed() -> pa.RecordBatch:
            return rows({
                "part": (pa.int32(), [part]), "number": (pa.int32(), [number]), "earlier": (pa.int64(), [earlier]),
                "first_key": (pa.int64(), [keys[0]]), "last_key": (pa.int64(), [keys[-1]]), "n_docs": (pa.int64(), [len(keys)]),
                "n_ids": (pa.int64(), [size]), "shard": (pa.binary(), [Shard.pack(np.array(keys, dtype=np.int64), documents)]),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for k in range(0, len(ids), 128):
                for key, d in zip(ids[k : k + 128], tokenizer.encode(texts.slice(k, 128).to_pylist()), strict=True):
                    d += end
                    if keys and size + len(d) // 4 > SHARD_IDS:
                        yield closed()
                        number, earlier, size, keys, documents = number + 1, earlier + size, 0, [], []
                    keys.append(NULL_KEY if key is None else key)
                    documents.append(d)
                    size += len(d) // 4
        gc.enable()
        if keys:
            yield closed()

    kept = id_and_text(docs, id_col, text_col)
    # an id (or null) that many rows share is spread by the texts' hashes
    ordered = kept.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").withColumn("part", F.spark_partition_id())
    written = ordered.mapInArrow(encode, SHARDS).write.options(**ROW_GROUPS)
    if buckets is None:
        written.parquet(path)
        return
    name = f"inkveil_shards_{uuid.uuid4().hex}"
    written.format("parquet").bucketBy(buckets, "part").option("path", path).saveAsTable(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # of an external table the files stay


def _shards(spark: SparkSession, path: str, buckets: int | None) -> DataFrame:
    """The shards' rows; with the number of buckets that they were written with, as a bucketed table."""
    if buckets is None:
        return spark.read.schema(SHARDS).parquet(path)
    name = f"inkveil_shards_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SHARDS}) USING parquet CLUSTERED BY (part) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the shards' bytes.

    `start` counts the ids of all documents before it. Only one sum for each part
    (a task that wrote; as many as shuffle partitions) is added up on the driver.
    """
    shards = spark.read.parquet(path)
    before, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before.append((part, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, part_start bigint"))  # a row for each part

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for data, begin in zip(batch.column("shard"), batch.column("begin").to_pylist(), strict=True):
                shard = Shard.parse(data.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(shard.keys == NULL_KEY, 0, shard.keys), mask=shard.keys == NULL_KEY),
                        pa.array(shard.offsets[:-1].astype(np.int64) + begin),
                        pa.array(np.diff(shard.offsets.astype(np.int64))),
                        pa.array([zlib.crc32(shard.document(k)) for k in range(len(shard.keys))], type=pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(starts, "part").select("shard", (F.col("part_start") + F.col("earlier")).alias("begin"))
    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fetch_tokens(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """The rows of read_shards() for the wanted keys, each found by its shard's perfect hash.

    A null key finds the documents without an id; of repeated stored ids all are
    returned, as they follow the one found; repeated keys count once, and keys that no
    shard holds give no row. Only one row of bounds for each part (a task that wrote)
    comes to the driver. Keys go to parts by these, then to shards by an equi-join on the
    part; if `buckets` is what write_shards() was given, only keys are shuffled, never shards.
    """
    shards = _shards(spark, path, buckets)
    bounds = shards.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"), F.sum("n_ids").alias("n")).collect()
    bounds.sort(key=lambda r: r["part"])
    part = np.array([r["part"] for r in bounds], dtype=np.int32)
    first, last = (np.array([r[c] for r in bounds], dtype=np.int64) for c in ("first", "last"))

    def route(batches: Batches) -> Batches:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            # an id that is repeated over the end of a part is in each of a run of parts
            low, high = np.searchsorted(last, key), np.searchsorted(first, key, side="right")
            n = np.maximum(high - low, 0)
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            yield rows({"part": (pa.int32(), part[at]), "key": (pa.int64(), np.repeat(key, n))})

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for data, begin, want in zip(batch.column("shard"), batch.column("begin").to_pylist(), batch.column("keys"), strict=True):
                shard, want = Shard.parse(data.as_buffer()), want.values.to_numpy(zero_copy_only=False)
                k = np.sort(shard.find(want))
                k = k[k >= 0]
                run = np.searchsorted(shard.keys, shard.keys[k], side="right") - k
                k = np.repeat(k - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum()) if len(k) else k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(shard.keys[k] == NULL_KEY, 0, shard.keys[k]), mask=shard.keys[k] == NULL_KEY),
                        pa.array(shard.offsets[k].astype(np.int64) + begin),
                        pa.array((shard.offsets[k + 1] - shard.offsets[k]).astype(np.int64)),
                        pa.array([zlib.crc32(shard.document(x)) for x in k.tolist()], type=pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    wanted = keys.select(F.coalesce(F.col(key_col).cast("bigint"), F.lit(NULL_KEY)).alias("key"))
    ranges = shards.select("part", "number", "first_key", "last_key")
    routed = wanted.mapInArrow(route, "part int, key bigint").join(ranges, "part").where("key BETWEEN first_key AND last_key")
    routed = routed.groupBy("part", F.col("number").alias("of")).agg(F.collect_set("key").alias("keys"))
    starts, at = [], 0
    for r in bounds:
        starts.append((r["part"], at))
        at += r["n"]
    begins = F.broadcast(spark.createDataFrame(starts, "part int, part_start bigint"))  # a row for each part
    # shards are bucketed by part alone, so the part alone is the join's key, and a range keeps the number from being another
    met = shards.select("part", "number", "earlier", "shard").join(routed.hint("shuffle_hash"), "part").where("of BETWEEN number AND number")
    met = met.join(begins, "part").select("shard", "keys", (F.col("part_start") + F.col("earlier")).alias("begin"))
    return met.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted keys; keys that no shard holds give no row.

    Keys are routed to shards by the shards' key ranges (equi-join on the part, then
    the range), gathered for each shard, and found there by the perfect hash. Of
    repeated stored ids the first is returned; null keys find nothing.
    """
    shards = spark.read.parquet(path)
    bounds = sorted((r["last"], r["part"]) for r in shards.groupBy("part").agg(F.max("last_key").alias("last")).collect())
    last, part = np.array([b[0] for b in bounds], dtype=np.int64), np.array([b[1] for b in bounds] + [-1], dtype=np.int32)

    def route(batches: Batches) -> Batches:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(part[np.searchsorted(last, key)])], names=["key", "part"])

    def find(batches: Batches) -> Batches:
        for batch in batches:
            for data, want in zip(batch.column("shard"), batch.column("keys"), strict=True):
                shard, want = Shard.parse(data.as_buffer()), np.array(want.as_py(), dtype=np.int64)
                at = shard.find(want)
                found = np.flatnonzero(at >= 0)
                yield rows({"doc_id": (pa.int64(), want[found]), "ids": (pa.list_(pa.int64()), [shard.document(k).tolist() for k in at[found]])})

    wanted = keys.select(F.col(key_col).cast("bigint").alias("key")).where("key IS NOT NULL").distinct().mapInArrow(route, "key bigint, part int")
    ranges = shards.select("part", "number", "first_key", "last_key")
    routed = wanted.join(ranges, "part").where("key BETWEEN first_key AND last_key").groupBy("part", "number").agg(F.collect_set("key").alias("keys"))
    return shards.join(routed, ["part", "number"]).select("shard", "keys").mapInArrow(find, "doc_id bigint, ids array<bigint>")


def stored_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """write_shards() to a fresh folder of the shared storage, then fetch_tokens() of every doc_id from it.

    doc_id, start, n_tokens, ids_crc32, a row for each input row: null texts count as
    empty and have the end id alone; null ids come first; rows that share an id follow
    each other by their texts' hashes; an empty table gives an empty table; other columns are not read.
    The shards stay where they are written until the caller drops them.
    """
    spark = docs.sparkSession
    path, buckets = fresh_path(spark, "token-shards"), 2 * partitions(spark)  # twice as many as parts, so that few parts share one
    write_shards(docs, vocabulary, path, buckets=buckets)
    return fetch_tokens(spark, path, docs, buckets=buckets)
