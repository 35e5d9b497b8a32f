"""SimHash near-duplicates: vantage-point trees over distinct fingerprints.

Fingerprints are computed where the texts are read. Exact copies share one
fingerprint, so only distinct fingerprints are searched. A small vantage-point tree,
fitted on a bounded sample, cuts Hamming space into shards; every fingerprint has
one home shard and is also sent to each later shard that its ball of the link
radius touches (triangle inequality). Inside a shard a second tree prunes branches
by the same bounds and compares what is left exactly. A shard returns the edges of
its components' stars only; stars are merged over all shards by alternating
large-star and small-star steps.

keep_one() drops copies down to a similarity of 0.8 of five-word runs. Prints of 64 bits
of such pairs differ in up to 24 bits, where strangers' often do too; so it searches prints
of 512 bits of the sets of runs, by the same two levels of vantage-point trees. Their nodes
are cut by the distance from a print or from the empty set (a set's size), whichever spares
more comparisons. What the search links is checked by exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, materialize, rows, stored, utf8

RADIUS = 4  # differing bits up to which two fingerprints link
SHINGLE = 4  # words
SEED = 42
SAMPLE = 20_000  # distinct fingerprints that place the top tree's vantage points and radii
SHARD_POINTS = 40_000  # fingerprints of a shard; a larger shard is searched in blocks of this size
QUERY_BLOCKS = 5  # times as many queries as points meet in one task; more are dealt over several
MAX_SHARDS = 4096  # leaves of the top tree, which is sent to all tasks
LEAF = 64  # points that are compared directly
PAIRS_AT_ONCE = 2_000_000

#: Near copies that keep_one() drops: a wider rule than the fingerprints' links.
COPY_SHINGLE = 5  # words
COPY_SIMILARITY = 0.8  # Jaccard similarity of the sets of runs from which two texts are copies
WORDS = 8  # of 64 bits, of a set's print
SMALL = 64  # runs up to which a set's print varies more
#: Differing bits up to which sets are candidates, for small and other sets: of the first word, the first two and all.
#: Pairs at similarity 0.8 exceed one of them with probability 5e-6 at most.
RADII = {True: (28, 48, 144), False: (24, 42, 120)}
CERTAIN = RADII[False][2] // 2  # bits around a vantage point within which all are candidates of each other
SPARED = 0.1  # of the comparisons that a cut has to spare
COMPARED_AT_ONCE, LINKED_AT_ONCE = 250_000, 200_000  # pairs
BLOCK_SETS, BLOCK_BYTES = 1_000, 16_000_000  # sets of a bucket that are compared with as many others in one task
COLUMNS_AT_ONCE = 2048


def shingle_hashes(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `width` words, lower-cased in ASCII; fewer words: of all of them."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    slices = map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """A bit is set if it is set in over half of a text's hashes; no hashes: zero."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    size = np.array([len(h) for h in hashes])
    full = np.flatnonzero(size)
    group: list[int] = []
    load = 0
    for k in [*full.tolist(), -1]:
        if k >= 0 and (not group or load + size[k] <= 500_000):
            group.append(k)
            load += size[k]
            continue
        if group:
            n = size[group]
            bits = np.unpackbits(np.concatenate([hashes[i] for i in group]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int64)
            out[group] = np.packbits(2 * count > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        group, load = [k], size[k] if k >= 0 else 0
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit fingerprint as a signed bigint."""

    def make(batches: Batches) -> Batches:
        for batch in batches:
            fp = fingerprints_of([shingle_hashes(d) for d in utf8(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kept = id_and_text(docs, id_col, text_col)
    return kept.mapInArrow(make, "doc_id bigint, fp bigint")


def _apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few, whose distances spread most, and their median; None if it can't split."""
    some = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    best = max((points[i] for i in rng.integers(0, len(points), 4)), key=lambda v: _apart(some, v).std())
    d = _apart(points, best)
    middle = int(np.median(d))
    if middle == d.max():
        middle -= 1
    return (best, middle) if d.min() <= middle else None


class ShardTree:
    """Nested (vantage, radius, inside, outside); leaves are shard numbers in order."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.rng, self.shards = np.random.default_rng(7), 0
        self.root = self._split(np.unique(sample), max(1, math.ceil(math.log2(max(1, leaves)))) if leaves > 1 else 0)

    def _split(self, points: np.ndarray, depth: int):  # noqa: ANN202
        if depth and len(points) > LEAF and (cut := _vantage(points, self.rng)):
            near = _apart(points, cut[0]) <= cut[1]
            return (*cut, self._split(points[near], depth - 1), self._split(points[~near], depth - 1))
        self.shards += 1
        return self.shards - 1

    def home(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), dtype=np.int32)
        for shard, at in self._visit(self.root, np.arange(len(fp)), fp, 0):
            out[at] = shard
        return out

    def touched(self, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, which) for each shard that balls around the fingerprints touch."""
        return self._visit(self.root, np.arange(len(fp)), fp, radius)

    def _visit(self, node, at: np.ndarray, fp: np.ndarray, radius: int):  # noqa: ANN001, ANN202
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at
            return
        vantage, reach, near, far = node
        d = _apart(fp[at], vantage).astype(np.int64)
        yield from self._visit(near, at[d <= reach + radius], fp, radius)
        yield from self._visit(far, at[d > reach - radius], fp, radius)


class Links:
    """Union-find over numbered fingerprints, in whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.parent[x], x):
            x = up
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.parent, b, a)
        self.parent = self.parent[self.parent]


def link_within(fp: np.ndarray, points: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component roots (as positions in fp) under links of queries to points; positions index fp."""
    links, rng = Links(len(fp)), np.random.default_rng(11)

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, PAIRS_AT_ONCE // len(p))
        for k in range(0, len(q), step):
            some = q[k : k + step]
            i, j = np.nonzero(_apart(fp[some][:, None], fp[p][None, :]) <= radius)
            apart = some[i] != p[j]
            links.unite(some[i][apart], p[j][apart])

    todo = [(points, queries)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        cut = _vantage(fp[p], rng) if len(p) > LEAF else None
        if cut is None:
            compare(p, q)
            continue
        dp, dq = _apart(fp[p], cut[0]).astype(np.int64), _apart(fp[q], cut[0]).astype(np.int64)
        todo += [(p[dp <= cut[1]], q[dq <= cut[1] + radius]), (p[dp > cut[1]], q[dq > cut[1] - radius])]
    return links.find(np.arange(len(fp)))


def _shard_stars(group: pd.DataFrame) -> pd.DataFrame:
    """Edges (fp, smallest linked fp of this group) of a block of a shard's points and a block of its queries."""
    fp = group["fp"].to_numpy().view(np.uint64)
    order = np.argsort(fp.view(np.int64), kind="stable")
    fp, is_point = fp[order], group["point"].to_numpy()[order]
    root = link_within(fp, np.flatnonzero(is_point), np.flatnonzero(~is_point))
    linked = fp[root] != fp  # a fingerprint may be point and query
    return pd.DataFrame({"u": fp[linked].view(np.int64), "v": fp[root[linked]].view(np.int64)})


def _star_steps(edges: DataFrame) -> DataFrame:
    """Components of an edge table (u, v), u > v: returns (u, root), one row for each u that isn't its root."""
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now


def link_fingerprints(found: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(fp, component_id) for every distinct fp of (doc_id, fp), by exact Hamming links.

    component_id is the smallest doc_id whose fingerprint is reachable. Null ids count only
    where a component has no other; repeated rows and an empty table are fine.
    """
    spark = found.sparkSession
    points = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = points.count()
    sample = [r[0] for r in points.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    tree = ShardTree(np.array(sample, dtype=np.int64).view(np.uint64), min(MAX_SHARDS, -(-n // shard_points)))
    sent = spark.sparkContext.broadcast(tree)

    def homes(batches: Batches) -> Batches:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield rows({"shard": (pa.int32(), sent.value.home(fp))})

    def touches(batches: Batches) -> Batches:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = sent.value.home(fp)
            met = [(shard, int((home[at] <= shard).sum())) for shard, at in sent.value.touched(fp, radius)]
            yield rows({"shard": (pa.int32(), [s for s, _ in met]), "n": (pa.int64(), [n for _, n in met])})

    # blocks of points and of queries of a shard that has more than its share; one small number for each leaf of the tree
    sizes = {r["shard"]: -(-r["count"] // shard_points) for r in points.select("fp").mapInArrow(homes, "shard int").groupBy("shard").count().collect()}
    asking = {r["shard"]: -(-r["n"] // (QUERY_BLOCKS * shard_points)) for r in points.select("fp").mapInArrow(touches, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            home = sent.value.home(fp)
            place = ((fp >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for shard, at in sent.value.touched(fp, radius):
                at = at[home[at] <= shard]  # a pair over two shards is found once, in the later one
                n_points, n_asking = sizes.get(shard, 0), max(asking[shard], 1)
                own = at[home[at] == shard]
                for who, block, query, point in [(own, place[own] % max(n_points, 1), np.full(len(own), q), True) for q in range(n_asking if n_points else 0)] + [(at, np.full(len(at), b), place[at] % n_asking, False) for b in range(n_points)]:
                    yield rows({"shard": (pa.int32(), np.full(len(who), shard)), "block": (pa.int32(), block), "query": (pa.int32(), query), "fp": (pa.int64(), signed[who]), "point": (pa.bool_(), np.full(len(who), point))})

    dealt = points.select("fp").mapInArrow(deal, "shard int, block int, query int, fp bigint, point boolean")
    edges = materialize(dealt.groupBy("shard", "block", "query").applyInPandas(_shard_stars, "u bigint, v bigint").distinct())
    if edges.isEmpty():
        return points.select("fp", F.col("rep").alias("component_id"))
    roots = materialize(_star_steps(edges))
    rooted = materialize(points.join(roots, points["fp"] == roots["u"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    Null and empty texts, and texts without words, have fingerprint zero and link
    like any other. Repeated rows share their fingerprint. A null doc_id is kept; it
    is a component's id only if the component has no other. An empty table gives an
    empty table. Other input columns are not read. Texts are not shuffled.
    """
    found = stored(fingerprint(docs, id_col, text_col), "fingerprints")
    linked = materialize(link_fingerprints(found))
    return found.join(linked, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copy_set(data: bytes) -> np.ndarray:
    """The distinct hashes of a text's runs of COPY_SHINGLE words, ascending."""
    return np.unique(shingle_hashes(data, COPY_SHINGLE))


def copy_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set in WORDS words: a bit is set if it is set in over half of what its hashes are mixed to."""
    out = np.zeros((len(sets), WORDS), dtype=np.uint64)
    steps = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row, hashes in zip(out, sets, strict=True):
        count = np.zeros(64 * WORDS, dtype=np.int64)
        for k in range(0, len(hashes), 255):
            z = hashes[k : k + 255, None] + steps
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.uint8)  # of 255 rows at most
        row[:] = np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)
    return out


class Prints:
    """Sets as the search sees them: how many runs they have, and their prints; radii by size."""

    def __init__(self, size: np.ndarray, words: np.ndarray):
        self.size, self.words = size, words
        small = size <= SMALL
        self.radii = [np.where(small, a, b) for a, b in zip(RADII[True], RADII[False], strict=True)]

    @classmethod
    def of(cls, size: np.ndarray, data: list[bytes]) -> Prints:
        return cls(size, np.frombuffer(b"".join(data), "<u8").reshape(-1, WORDS))

    def sides(self, at: np.ndarray, vantage: np.ndarray | None, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which are inside the cut, and which have balls that reach inside and outside.

        Without a vantage point the distance is that from the empty set: sets that are COPY_SIMILARITY
        alike have sizes in that ratio at least.
        """
        if vantage is None:
            n = self.size[at]
            return n <= cut, n * COPY_SIMILARITY <= cut, n >= (cut + 1) * COPY_SIMILARITY
        d = np.bitwise_count(self.words[at] ^ vantage).sum(axis=1, dtype=np.int64)
        return d <= cut, d <= cut + self.radii[2][at], d > cut - self.radii[2][at]

    def cut(self, at: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, int] | None:
        """The vantage point and distance that spare most comparisons of these sets with each other; None if they spare few."""
        some = at if len(at) <= 512 else at[rng.integers(0, len(at), 512)]
        options: list[tuple[np.ndarray | None, int]] = [(None, int(np.median(self.size[some])))]
        for i in rng.integers(0, len(some), 3):
            d = np.bitwise_count(self.words[some] ^ self.words[some[i]]).sum(axis=1, dtype=np.int64)
            options += [(self.words[some[i]], int(np.median(d))), (self.words[some[i]], CERTAIN)]

        def work(option: tuple[np.ndarray | None, int]) -> float:
            inside, near, far = self.sides(some, *option)
            share, certain = inside.mean(), option[0] is not None and option[1] <= CERTAIN
            if share in (0, 1) and not certain:
                return 1.0
            return share * (near.mean() - share * certain) + (1 - share) * far.mean()

        best = min(options, key=work)
        return best if work(best) < 1 - SPARED else None


class CopyTree:
    """Nested (vantage, distance, inside, outside) over sets' sizes and prints; leaves are shard numbers in order."""

    def __init__(self, sample: Prints, leaves: int):
        self.rng, self.shards = np.random.default_rng(7), 0
        self.root = self._split(sample, np.arange(len(sample.size)), math.ceil(math.log2(max(1, leaves))))

    def _split(self, sample: Prints, at: np.ndarray, depth: int):  # noqa: ANN202
        if depth and len(at) > LEAF and (cut := sample.cut(at, self.rng)) and not (inside := sample.sides(at, *cut)[0]).all():
            return (*cut, self._split(sample, at[inside], depth - 1), self._split(sample, at[~inside], depth - 1))
        self.shards += 1
        return self.shards - 1

    def home(self, sets: Prints) -> np.ndarray:
        out = np.zeros(len(sets.size), dtype=np.int32)
        for shard, at in self._visit(self.root, np.arange(len(out)), sets, balls=False):
            out[at] = shard
        return out

    def touched(self, sets: Prints) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, which) for each shard that the sets' balls touch."""
        return self._visit(self.root, np.arange(len(sets.size)), sets, balls=True)

    def _visit(self, node, at: np.ndarray, sets: Prints, *, balls: bool):  # noqa: ANN001, ANN202
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at
            return
        inside, near, far = sets.sides(at, node[0], node[1])
        yield from self._visit(node[2], at[near if balls else inside], sets, balls=balls)
        yield from self._visit(node[3], at[far if balls else ~inside], sets, balls=balls)


def link_copies(sets: Prints, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Component roots (as positions) under links of queries to points whose prints are near enough for copies."""
    links, rng = Links(len(sets.size)), np.random.default_rng(11)
    first, second = (np.ascontiguousarray(sets.words[:, k]) for k in (0, 1))
    limit = sets.radii[0].astype(np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def unite() -> None:
        if found:
            links.unite(*map(np.concatenate, zip(*found, strict=True)))
            links.parent = links.find(links.parent)
            found.clear()

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        p, q = p[np.argsort(sets.size[p])], q[np.argsort(sets.size[q])]
        of_points, sizes = first[p], sets.size[p]
        k = 0
        while k < len(q):
            # points of sizes that the next queries can have copies of
            low = np.searchsorted(sizes, sets.size[q[k]] * COPY_SIMILARITY)
            high = np.searchsorted(sizes, sets.size[q[k]] / COPY_SIMILARITY, "right")
            some = q[k : k + max(1, COMPARED_AT_ONCE // max(1, high - low))]
            some = some[sets.size[some] <= 1.02 * sets.size[some[0]]]
            k += len(some)
            high = np.searchsorted(sizes, sets.size[some[-1]] / COPY_SIMILARITY, "right")
            if low == high:
                continue
            apart = _apart(first[some][:, None], of_points[low:high])
            hit = np.flatnonzero(apart <= limit[some][:, None])
            i, j = some[hit // (high - low)], p[low:high][hit % (high - low)]
            near = apart.ravel()[hit] + _apart(second[i], second[j]) <= sets.radii[1][i]
            i, j = i[near], j[near]
            new = links.parent[i] != links.parent[j]
            i, j = i[new], j[new]
            near = _apart(sets.words[i], sets.words[j]).sum(axis=1, dtype=np.int64) <= sets.radii[2][i]
            if near.any():
                found.append((i[near], j[near]))
                if sum(len(x) for x, _ in found) > LINKED_AT_ONCE:
                    unite()

    todo = [(points, queries)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        cut = sets.cut(p, rng) if len(p) > LEAF else None
        if cut is None:
            compare(p, q)
            continue
        inside, (asking, near, far) = sets.sides(p, *cut)[0], sets.sides(q, *cut)
        if cut[0] is not None and cut[1] <= CERTAIN:
            every = np.concatenate([p[inside], q[asking]])
            found.append((every[1:], np.full(max(len(every) - 1, 0), every[0] if len(every) else 0)))
            near = near & ~asking
        if inside.all():
            compare(p, q[near])
            continue
        todo += [(p[inside], q[near]), (p[~inside], q[far])]
    unite()
    return links.find(np.arange(len(sets.size)))


def _copy_stars(group: pd.DataFrame) -> pd.DataFrame:
    """Edges (digest, least linked digest of this group) of a block of a shard's points and a block of its queries."""
    group = group.sort_values("digest")
    digest, is_point = group["digest"].to_numpy(), group["point"].to_numpy()
    root = link_copies(Prints.of(group["size"].to_numpy(), group["print"].tolist()), np.flatnonzero(is_point), np.flatnonzero(~is_point))
    linked = digest[root] != digest  # a set may be point and query
    return pd.DataFrame({"u": digest[linked], "v": digest[root[linked]]})


def copy_candidates(points: DataFrame, shard_points: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, whose components hold all candidates: digests of points (digest, size, print) with near prints."""
    spark, share = points.sparkSession, shard_points or SHARD_POINTS
    n = points.count()
    sample = points.orderBy(F.xxhash64("digest")).limit(SAMPLE).select("size", "print").collect()
    sent = spark.sparkContext.broadcast(CopyTree(Prints.of(np.array([r[0] for r in sample], dtype=np.int64), [bytes(r[1]) for r in sample]), min(MAX_SHARDS, -(-n // share))))

    def read(batch: pa.RecordBatch) -> Prints:
        return Prints.of(batch.column("size").to_numpy(zero_copy_only=False), batch.column("print").to_pylist())

    def count(batches: Batches) -> Batches:
        for batch in batches:
            sets = read(batch)
            home = sent.value.home(sets)
            met = [(shard, int((home == shard).sum()), int((home[at] <= shard).sum())) for shard, at in sent.value.touched(sets)]
            yield rows({c: (pa.int64(), [m[k] for m in met]) for k, c in enumerate(("shard", "own", "met"))})

    # blocks of points and of queries of a shard that has more than its share; one small row for each leaf of the tree
    counted = points.mapInArrow(count, "shard bigint, own bigint, met bigint").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("met").alias("met")).collect()
    blocks = {r["shard"]: (-(-r["own"] // share), max(1, -(-r["met"] // (QUERY_BLOCKS * share)))) for r in counted}

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            sets, digest = read(batch), batch.column("digest").to_numpy(zero_copy_only=False)
            home = sent.value.home(sets)
            place = (digest.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for shard, at in sent.value.touched(sets):
                at = at[home[at] <= shard]  # a pair over two shards is found once, in the later one
                n_points, n_asking = blocks[shard]
                own = at[home[at] == shard]
                parts = [(own, place[own] % max(n_points, 1), np.full(len(own), q), True) for q in range(n_asking if n_points else 0)]
                parts += [(at, np.full(len(at), b), place[at] % n_asking, False) for b in range(n_points)]
                for who, block, query, point in parts:
                    kept = batch.select(["digest", "size", "print"]).take(pa.array(who))
                    where = [pa.array(v, type=pa.int32()) for v in (np.full(len(who), shard), block, query)]
                    yield pa.RecordBatch.from_arrays([*where, *kept.columns, pa.array(np.full(len(who), point))], names=["shard", "block", "query", *kept.schema.names, "point"])

    dealt = points.mapInArrow(deal, "shard int, block int, query int, digest bigint, size bigint, print binary, point boolean")
    return materialize(dealt.groupBy("shard", "block", "query").applyInPandas(_copy_stars, "u bigint, v bigint").distinct())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of digests whose sets have the similarity of copies, u > v."""

    def check(batches: Batches) -> Batches:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            near = pa.array([similarity(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= COPY_SIMILARITY for a, b in zip(x, y, strict=True)], type=pa.bool_())
            yield batch.select(["u", "v"]).filter(near)

    first, second = (sets.select(F.col("digest").alias(k), F.col("hashes").alias(c)) for k, c in (("u", "x"), ("v", "y")))
    return materialize(pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y").mapInArrow(check, "u bigint, v bigint"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the left shares with each of the right."""
    out = np.zeros((len(left), len(right)))
    if not left or not right:
        return out
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    cells = []
    for sets, every in ((left, x), (right, y)):
        row = np.repeat(np.arange(len(sets)), [len(z) for z in sets])
        column = np.searchsorted(both, every)
        held = both[np.minimum(column, len(both) - 1)] == every if len(both) else np.zeros(len(every), bool)
        row, column = row[held], column[held]
        order = np.argsort(column, kind="stable")
        cells.append((row[order], column[order]))
    for low in range(0, len(both), COLUMNS_AT_ONCE):
        parts = []
        for (row, column), n in zip(cells, out.shape, strict=True):
            a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
            part = np.zeros((n, COLUMNS_AT_ONCE), dtype=np.float32)
            part[row[a:b], column[a:b] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joined_roots(group: pd.DataFrame) -> pd.DataFrame:
    """(u, v): components that copies of this block join, each with the least one that it is joined to."""
    asking = group["asking"].to_numpy()
    root = group["root"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in group["hashes"]]
    q, p = np.flatnonzero(asking), np.flatnonzero(~asking)
    shared = overlaps([sets[k] for k in q], [sets[k] for k in p])
    size = np.array([len(x) for x in sets], dtype=float)
    every = np.maximum(size[q][:, None] + size[p][None, :] - shared, 1)
    i, j = np.nonzero((shared / every >= COPY_SIMILARITY) & (root[q][:, None] != root[p][None, :]))
    names, number = np.unique(root, return_inverse=True)
    links = Links(len(names))
    links.unite(number[q[i]], number[p[j]])
    up = links.find(np.arange(len(names)))
    joined = np.flatnonzero(up != np.arange(len(names)))
    return pd.DataFrame({"u": names[joined], "v": names[up[joined]]})


def _across(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """Components (u, v), u > v, that copies in a common bucket join; labelled: bucket, digest, root.

    Only buckets of several components take part, and of their sets only those that can
    have a copy at all: runs that no other candidate holds can't be shared, so a set
    with more than a fifth of such runs has none. In each bucket the sets outside its
    largest component are compared with all, in blocks of bounded size; a block returns
    what its links join, never the pairs.
    """
    parts = labelled.groupBy("bucket", "root").count().groupBy("bucket").agg(F.count("*").alias("parts")).where("parts > 1")
    mixed = materialize(labelled.join(parts.select("bucket"), "bucket"))
    taking = sets.join(mixed.select("digest").distinct(), "digest", "left_semi")

    def runs(batches: Batches) -> Batches:
        for batch in batches:
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                yield rows({"digest": (pa.int64(), np.full(len(data) // 8, digest)), "run": (pa.int64(), np.frombuffer(data, "<i8"))})

    alone = taking.mapInArrow(runs, "digest bigint, run bigint").groupBy("run").agg(F.count("*").alias("n"), F.min("digest").alias("digest")).where("n = 1").groupBy("digest").agg(F.count("*").alias("alone"))
    size = F.octet_length("hashes") / 8
    can = taking.join(alone, "digest", "left").where(size - F.coalesce("alone", F.lit(0)) >= size * COPY_SIMILARITY).select("digest", F.octet_length("hashes").alias("size"))
    able = materialize(mixed.join(can, "digest"))
    by_root = able.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("size").alias("size")).where("parts > 1")
    blocks = lambda n: F.greatest(F.ceil(F.col("size") / BLOCK_BYTES), F.ceil(n / BLOCK_SETS)).cast("int")
    whole = whole.select("bucket", "top", blocks(F.col("n") - F.col("most")).alias("n_asking"), blocks(F.col("n")).alias("n_all"))
    placed = able.join(whole, "bucket").select("bucket", "digest", "root", "top", "n_asking", "n_all", F.xxhash64("digest").alias("place"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answering = placed.select("bucket", every("n_asking").alias("a"), F.pmod("place", "n_all").alias("b"), "digest", "root", F.lit(False).alias("asking"))
    asking = placed.where("root <> top").select("bucket", F.pmod("place", "n_asking").alias("a"), every("n_all").alias("b"), "digest", "root", F.lit(True).alias("asking"))
    dealt = asking.unionByName(answering).join(sets, "digest")
    return materialize(dealt.groupBy("bucket", "a", "b").applyInPandas(_joined_roots, "u bigint, v bigint").distinct())


def copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, root) for every row: root is shared by the rows whose sets of runs exact links connect.

    hash is Spark's xxhash64 of the text (null: of the empty one). Sets link if their
    Jaccard similarity is at least COPY_SIMILARITY. Candidates are the components of near
    prints, which vantage-point trees find (copy_candidates); first each set is compared with
    its component's least digest, in linear work; then, in components where not all are
    its copies, the others are compared with all in blocks (_across). A link is missed
    only if the prints differ by more than RADII: 5 in a million at similarity 0.8 at most. Texts
    without words are copies of each other.
    """

    def sign(batches: Batches) -> Batches:
        for batch in batches:
            found = [copy_set(d) for d in utf8(batch)]
            digests = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], dtype=np.uint64)
            size = pa.array([len(x) for x in found], type=pa.int64())
            prints = pa.array([x.tobytes() for x in copy_prints(found)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(digests.view(np.int64)), size, prints], names=["doc_id", "hash", "digest", "size", "print"])

    def whole_sets(batches: Batches) -> Batches:
        for batch in batches:
            found = [copy_set(d).tobytes() for d in utf8(batch)]
            digests = np.array([xxhash.xxh64_intdigest(x) for x in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(found, type=pa.binary())], names=["digest", "hashes"])

    kept = id_and_text(docs, id_col, text_col)
    found = stored(kept.select("*", F.xxhash64("text").alias("hash")).mapInArrow(sign, "doc_id bigint, hash bigint, digest bigint, size bigint, print binary"), "signatures")
    alone = found.select("doc_id", "hash", F.col("digest").alias("root"))
    points = materialize(found.where("size > 0").groupBy("digest").agg(F.first("size").alias("size"), F.first("print").alias("print")))
    near = copy_candidates(points)
    if near.isEmpty():
        return alone
    joined = materialize(_star_steps(near))
    to_leader = joined.select("u", F.col("root").alias("v"))
    leaders = joined.select(F.col("root").alias("digest")).distinct().withColumn("bucket", F.col("digest"))
    shared = materialize(leaders.unionByName(joined.select(F.col("u").alias("digest"), F.col("root").alias("bucket"))).withColumn("leader", F.col("bucket")))

    # one row that holds each candidate set; rows without an id are all looked through
    candidates = shared.select("digest")
    ids = found.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("rep")).select("rep").distinct()
    texts = kept.join(ids, kept["doc_id"].eqNullSafe(ids["rep"]), "left_semi").mapInArrow(whole_sets, "digest bigint, hashes binary")
    sets = stored(texts.join(candidates, "digest", "left_semi").dropDuplicates(["digest"]), "sets")

    links = _verified(to_leader, sets)
    near = links.select(F.col("u").alias("digest"), F.col("v").alias("leader"), F.lit(True).alias("near"))
    # in each bucket, what is linked to its leader is one component so far
    labelled = shared.join(near, ["digest", "leader"], "left").select("bucket", "digest", F.when(F.col("near"), F.col("leader")).otherwise(F.col("digest")).alias("root"))
    edges = links.unionByName(_across(materialize(labelled), sets))
    if edges.isEmpty():
        return alone
    roots = materialize(_star_steps(edges))
    return found.join(roots, found["digest"] == roots["u"], "left").select("doc_id", "hash", F.coalesce("root", "digest").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies (the smallest doc_id), with all input columns.

    Near copies by copy_components(), not by near_duplicates(). Of rows that share the
    smallest id, the one whose text has the least hash stays; a null id stays only in
    components without another. Rows of equal id and text are one document: any one of
    them stays. Null and empty texts are copies of each other. An empty table gives an
    empty table; other columns aren't read. Texts are shuffled only for repeated rows,
    or where the kept rows' keys are too many for Spark to broadcast.
    """
    linked = copy_components(docs, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")
    by_row = linked.groupBy("root", row.alias("row")).agg(F.count("*").alias("n"))
    keep = materialize(by_row.groupBy("root").agg(F.min_by(F.struct("row", "n"), "row").alias("k")).select(F.col("k.row.none").alias("__none"), F.col("k.row.id").alias("__id"), F.col("k.row.hash").alias("__hash"), F.col("k.n").alias("__n")))
    keyed = docs.select("*", F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"))
    kept = keyed.join(keep, ["__none", "__id", "__hash"])
    once = kept.where("__n > 1").dropDuplicates(["__none", "__id", "__hash"])
    return kept.where("__n = 1").unionByName(once).select(*docs.columns)
