"""Merkle manifest of a dataset: a hash tree over each group's rows and one over the groups, with a proof for every row.

Rows of a group are leaves in ascending order of their id. Eight consecutive nodes become one,
level by level, until one remains; the groups' last nodes are joined in the same way.

Work goes by superblocks, 8^4 consecutive nodes of a tree (a parameter). Upward, each superblock is reduced to
its node; these nodes form the next layer, which is about 4,096 times smaller, until every tree is
one node. Downward, the nodes of a layer are cogrouped by superblock with the outer nodes that their
superblock needs for a proof (at most seven for each level above). There the local reduction is done
once more, its siblings join the outer ones, and the proof is hashed and folded at once: no row of a
proof is ever shuffled. A superblock is the most that meets in one place, however large a group is.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm._common import drop, fresh_path, materialize, partitions, stored
from inkveil.llm.line_dedup import ascii_lower

WIDTH = 8  # nodes that become one
DEPTH = 4  # levels within a superblock, so that it has 4,096 nodes

_PATH = "array<struct<before:string,after:string>>"
#: The steps from a node to the root: hex digests of the siblings left and right of the path, level by level.
Path = list[tuple[str, str]]


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and the value; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(id_col: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex SHA-256 of the framed values, one after the other."""
    return F.sha2(F.concat(*map(framed, (id_col, source, lang, n_chars, text))), 256)


def rank_in_tree(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (tree, ...) with pos, from 0 in the tree by `order` (which must tell rows apart), and size, the tree's nodes.

    Nodes are dealt by ranges of (tree, order), so that a large tree is spread; numbered within
    each range; and moved on by the sizes of the tree's ranges before.
    """
    dealt = materialize(nodes.repartitionByRange(partitions(nodes.sparkSession), "tree", *order).withColumn("range", F.spark_partition_id()))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, and one more for each tree
    ranges = dealt.groupBy("range", "tree").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", "tree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("size"))
    within = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(ranges, ["range", "tree"]).withColumn("pos", F.col("within") + F.col("skip")).drop("range", "within", "skip")


def _levels(size: int, depth: int) -> int:
    """Levels that are built within the superblocks of a tree of this many nodes."""
    k = 0
    while k < depth and size > WIDTH**k:
        k += 1
    return k


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels over consecutive nodes, themselves first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[k : k + WIDTH])) for k in range(0, len(nodes), WIDTH)]
        out.append(nodes)
    return out


def _paths(levels: list[list[str]]) -> list[Path]:
    """For each node of the lowest level the siblings on its way to the highest."""
    out: list[Path] = [[] for _ in levels[-1]]
    for level in reversed(levels[:-1]):
        steps = []
        for k in range(len(level)):
            first = k - k % WIDTH
            steps.append(("".join(level[first:k]), "".join(level[k + 1 : first + WIDTH])))
        out = [[step, *out[k // WIDTH]] for k, step in enumerate(steps)]
    return out


def fold(node: str, path: Path) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _block(depth: int) -> Column:
    return F.expr(f"pos div {WIDTH**depth}").alias("block")


def next_layer(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, pos, node, size of the superblocks of a layer (tree, pos, node, size)."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree, block, size = pdf["tree"].iloc[0], int(pdf["pos"].iloc[0]) // WIDTH**depth, int(pdf["size"].iloc[0])
        top = _reduced(pdf["node"].tolist(), _levels(size, depth))[-1]
        return pd.DataFrame({"tree": [tree], "pos": [block], "node": top, "size": [-(-size // WIDTH**depth)]})

    return nodes.select("tree", "pos", "node", "size").groupBy("tree", _block(depth)).applyInPandas(reduce, "tree string, pos bigint, node string, size bigint")


def _outer_path(outer: pd.DataFrame) -> Path:
    return [(s["before"], s["after"]) for s in outer["path"].iloc[0]] if len(outer) else []


def node_paths(nodes: DataFrame, outer: DataFrame | None, depth: int = DEPTH) -> DataFrame:
    """tree, pos, path of the nodes of a layer; outer: the same of its superblocks (None: they are roots)."""
    kept = nodes.select("tree", "pos", "node", "size", _block(depth))
    schema = f"tree string, pos bigint, path {_PATH}"

    def extend(pdf: pd.DataFrame, rest: Path) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        inner = _paths(_reduced(pdf["node"].tolist(), _levels(int(pdf["size"].iloc[0]), depth)))
        path = [[{"before": a, "after": b} for a, b in steps + rest] for steps in inner]
        return pd.DataFrame({"tree": pdf["tree"], "pos": pdf["pos"], "path": path})

    if outer is None:
        return kept.groupBy("tree", "block").applyInPandas(lambda pdf: extend(pdf, []), schema)
    by_block = outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return kept.groupBy("tree", "block").cogroup(by_block).applyInPandas(lambda pdf, outer: extend(pdf, _outer_path(outer)), schema)


def layers_of(nodes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """The layers from `nodes` (tree, pos, node, size) to the one where every tree is one node."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        out.append(materialize(next_layer(out[-1], depth)))
    return out


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", depth: int = DEPTH) -> DataFrame:
    """Leaf, subtree root, root and proof of every row, and what its tampered copy folds to.

    Columns: doc_id, leaf, subroot (of the row's group), root, proof_sha256 (hex SHA-256 of the
    siblings on the way to the root, level by level, left to right), folded_root (of the leaf of
    the tampered row, if crc32 of its decimal id is divisible by 3, else of its own, with the
    original siblings), verified (it equals root). Tampering puts A-Z of the text in lower case.

    docs: id, source, lang, n_chars, text; other columns are not read. Null values are
    dashes in the leaf. A null group is a group of its own, before all others. In a group a null id
    comes first; rows of one id go by their leaf, equal rows anyhow (their proofs differ by
    place). A null id is never tampered with. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "source", F.col(group_col).alias("lang"), "n_chars", F.col(text_col).alias("text"))
    leaf = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    own = leaf(F.col("text"))
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        "doc_id",
        # an ordered key without nulls: the null group is the least
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        own.alias("node"),
        F.when(chosen, leaf(ascii_lower(F.col("text")))).otherwise(own).alias("shown"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    # written once, so row numbers stay, and texts are read once
    spark = docs.sparkSession
    leaves.write.parquet(path := fresh_path(spark, "leaves"))
    placed = stored(rank_in_tree(spark.read.parquet(path), "doc_id", "node", "row_no").drop("row_no"), "placed-leaves")
    drop(spark, path)
    layers = layers_of(placed, depth)

    # the trees' last nodes are the leaves of one tree over all; its name can't be a group's
    subroots = rank_in_tree(layers[-1].select(F.lit("*").alias("tree"), F.col("tree").alias("group"), "node"), "group")
    subroots = materialize(subroots)
    top = layers_of(subroots, depth)
    outer = None
    for layer in reversed(top):
        outer = node_paths(layer, outer, depth)
    roots = top[-1].select("tree", F.col("node").alias("root"))
    # a row for each group: its own node, the root, and the steps between
    outer = subroots.join(outer, ["tree", "pos"]).join(roots, "tree").select(F.col("group").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    groups = materialize(outer)
    outer = groups.select("tree", "pos", "path")
    for layer in reversed(layers[1:-1]):
        outer = materialize(node_paths(layer, outer, depth))

    def prove(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rest = _outer_path(outer)
        paths = [steps + rest for steps in _paths(_reduced(pdf["node"].tolist(), _levels(int(pdf["size"].iloc[0]), depth)))]
        proofs = [digest("".join(a + b for a, b in path)) for path in paths]
        folded = [fold(node, path) for node, path in zip(pdf["shown"], paths, strict=True)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": pdf["node"], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0], "proof_sha256": proofs, "folded_root": folded}).assign(verified=lambda x: x["folded_root"] == x["root"])

    needed = outer.join(groups.select("tree", "subroot", "root"), "tree").withColumnRenamed("pos", "block")
    kept = placed.select("tree", "pos", "node", "shown", "size", "doc_id", _block(depth))
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return kept.groupBy("tree", "block").cogroup(needed.groupBy("tree", "block")).applyInPandas(prove, schema)


def oracle_sql(group_levels: int = 7, top_levels: int = 3) -> str:
    """DuckDB SQL for the rows of op12 over up to 8^7 rows of a group and 8^3 groups; each level is written out."""
    framed = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(framed, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte_steps = f"list_reduce(range(8), lambda c, i: {step}, xor(crc, byte))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda crc, byte: {byte_steps}, CAST(4294967295 AS BIGINT)), 4294967295)"

    def levels(name: str, n: int) -> list[str]:
        out = []
        for j in range(n):
            out.append(
                f"{name}{j + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN any_value(size) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node, (any_value(size) + 7) // 8 AS size FROM {name}{j} GROUP BY tree, pos // 8)"
            )
            out.append(
                f"{name}s{j} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, any_value(a.size) AS size FROM {name}{j} a JOIN {name}{j} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.pos)"
            )
        return out

    def folds(start: str, name: str, n: int, key: str) -> list[str]:
        return [
            f"{name}f{j + 1} AS (SELECT f.* REPLACE (CASE WHEN s.size > 1 THEN sha256(concat(s.l, folded, s.r)) ELSE folded END AS folded, CASE WHEN s.size > 1 THEN concat(proof, s.l, s.r) ELSE proof END AS proof, f.{key} // 8 AS {key}) FROM {f'{name}f{j}' if j else start} f JOIN {name}s{j} s ON {'f.tree = s.tree AND ' if name == 'g' else ''}f.{key} = s.pos)"
            for j in range(n)
        ]

    parts = [
        f"leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS folded FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaf)",
        "g0 AS (SELECT tree, pos, leaf AS node, size FROM placed)",
        *levels("g", group_levels),
        f"sub AS (SELECT tree AS name, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size FROM g{group_levels})",
        "t0 AS (SELECT '*' AS tree, place AS pos, subroot AS node, size FROM sub)",
        *levels("t", top_levels),
        "start AS (SELECT doc_id, placed.tree, leaf, subroot, place, pos, folded, '' AS proof FROM placed JOIN sub ON placed.tree = sub.name)",
        *folds("start", "g", group_levels, "pos"),
        *folds(f"gf{group_levels}", "t", top_levels, "place"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM tf{top_levels}, t{top_levels}"
