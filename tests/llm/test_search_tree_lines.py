"""Ranked search, the Merkle manifest and line dedup against plain statements of their rules, and against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from inkveil.llm import line_dedup, merkle, queries, ranked_search

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, score string, node string, pos string, places string, key string, terms string, tree string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """rows: (doc_id, source, lang, n_chars, text), with further columns whose names clash."""
    return spark.createDataFrame([(*r, *"snpkitt") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest", "op13_line_dedup"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), con.execute(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


# ---- ranked search


def slow_ranks(docs, items, top):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counted = [(d, Counter(split(t))) for d, t in docs]
    held = [c for _, c in counted if c]
    n_docs, length = len(held), sum(c.total() for c in held)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(split(text))
    out = []
    for item, wanted in terms.items():
        scored = []
        for d, c in counted:
            score = 0
            for t in wanted & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for x in held) + 1)))
                m = 100 - 90 + (90 * c.total() * n_docs) // length
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("items_at_once", [20_000, 2])
def test_ranks_against_slow_statement(spark, monkeypatch, items_at_once):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", items_at_once)
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "été", "日本", "x1", "İ", "zeta"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ".", "\n", "__"]) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (100, None), (101, ""), (102, "-- !!"), (200, "beta " * 40_000)]
    items = [(1, "alpha, BETA?"), (2, "日本 été"), (2, "zeta"), (3, None), (4, ""), (None, "x1 İ"), (5, "nowhere"), (6, "alpha alpha"), (6, "alpha alpha")]
    given = spark.createDataFrame(items, "item_id bigint, text string")
    df = table(spark, [(d, None, None, None, t) for d, t in docs]).repartition(4)
    for top in (3, 1000):
        assert shown(ranked_search.rank_documents(df, given, top)) == slow_ranks(docs, items, top)
    assert ranked_search.rank_documents(df.limit(0), given).count() == 0
    none = ranked_search.rank_documents(df, given.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = ("Word wörter, " * 500 + "x" * 90).encode()
    want = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    assert ranked_search.term_counts(text) == want == Counter({b"word": 500, "wörter".encode(): 500, b"x" * 90: 1})


def test_heaps_keep_the_best_of_all():
    import numpy as np

    rng = random.Random(2)
    heaps, every = ranked_search.Heaps(3, 4), []
    for begin in range(0, 60, 5):
        ids = [begin + k for k in range(5)]
        rng.shuffle(ids)
        scores = np.array([[rng.randint(0, 3) for _ in range(3)] for _ in ids])
        every += [(item, -int(s[item]), d) for d, s in zip(ids, scores, strict=True) for item in range(3) if s[item]]
        heaps.add(scores, ids)
    want = [(item, d, -s) for k in range(3) for item, s, d in sorted(e for e in every if e[0] == k)[:4]]
    assert sorted(heaps.rows()) == sorted(want)


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(leaves):
    """The root and each leaf's siblings, by following every leaf through all levels."""
    siblings, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, place in enumerate(at):
            first = place // 8 * 8
            siblings[k].append((leaves[first:place], leaves[place + 1 : first + 8]))
        leaves = [h(*leaves[k : k + 8]) for k in range(0, len(leaves), 8)]
        at = [p // 8 for p in at]
    return leaves[0], siblings


def slow_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, source, lang, n, text = r
        leaf = framed(*r[:3], n, text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        shown = framed(doc_id, source, lang, n, text and text.translate(LOWER)) if tampered else leaf
        groups[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, shown))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = slow_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, tops, strict=True):
        for (_, doc_id, leaf, folded), inner in zip(sorted(groups[g]), trees[g][1], strict=True):
            path = inner + above
            for before, after in path:
                folded = h(*before, folded, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out.append((doc_id, leaf, trees[g][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_against_slow_statement(spark, depth):
    rng = random.Random(3)
    rows = [(k, rng.choice(["web", None, "é"]), rng.choice(["en", "en", "en", "日本", "ÿ", "", None]), rng.choice([None, k]), rng.choice(["Ab É", "low", "", None])) for k in range(700)]
    rows += [(5, "web", "one", 1, "Alone"), (None, "web", "en", 1, "No id"), (None, "x", "en", 1, "No id"), (9, "dup", "en", 2, "Same"), (9, "dup", "en", 2, "Same"), (4, "long", "en", 1, "Wörter " * 30_000)]
    rows += [(k, "s", f"l{k % 70}", k, "T") for k in range(1000, 1140)]
    df = table(spark, rows).repartition(5)
    got = merkle.manifest(df, depth=depth)
    assert sorted(map(tuple, got.collect()), key=str) == slow_manifest(rows)


def test_small_manifests(spark):
    one = [(3, None, None, None, None)]
    assert [tuple(r) for r in merkle.manifest(table(spark, one)).collect()] == slow_manifest(one)
    assert merkle.manifest(table(spark, one).limit(0)).count() == 0


# ---- lines


def slow_lines(rows, least_docs, least_chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    shared = {k for k, docs in held.items() if len(k) >= least_chars and len(docs) >= least_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in shared]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_against_slow_statement(spark):
    rng = random.Random(4)
    pool = ["License", " license\t", "LICENSE\r", "İstanbul", "istanbul", "", "  ", "x", "日本", "a b", "\x0b\x0cÉ", " wide "]
    rows = [(k, "\n".join(rng.choices(pool + [f"own {k}"], k=rng.randint(0, 9)))) for k in range(80)]
    rows += [(1, "x\nx"), (1, "x\nx"), (None, "x\nonly here"), (None, "only here"), (90, None), (91, ""), (92, "\n\n"), (93, "License\n" * 20_000 + "end"), (94, "License")]
    df = table(spark, [(d, None, None, None, t) for d, t in rows]).repartition(4)
    for docs, chars in ((10, 1), (3, 2), (1, 1)):
        got = line_dedup.drop_shared_lines(df, docs, chars)
        assert sorted(map(tuple, got.collect()), key=str) == slow_lines(rows, docs, chars)
    assert line_dedup.drop_shared_lines(df.limit(0)).count() == 0


def test_lines_run_no_python(spark, capsys):
    queries.op13_line_dedup(spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
