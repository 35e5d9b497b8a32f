"""The operators on small tables, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import chat_quotes, decontam, html_extract, multiset_fp, piece_codec, queries, secret_scan, simhash_vp, token_count, token_store, toxicity

DATA = "/root/testdata/sf0.001"
RNG = random.Random(9)
CLASH = "doc_id bigint, text string, score double, fingerprint string, spans string, ids string, piece_ids string, head string, hash bigint"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(k, t, 0.5, "f", "s", "i", "p", "h", 1) for k, t in enumerate(texts, start)], CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null text, empty and very long texts, repeated rows."""
    rows = [(1, "one two three four five six"), (None, "no id at all"), (2, None), (3, ""), (1, "one two three four five six"), (4, "word " * 30_000), (5, "日本 é")]
    return spark.createDataFrame([(*r, 0.5, "f", "s", "i", "p", "h", 1) for r in rows], CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_secret_columns(spark, odd, none):
    df = documents(spark, ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "plain"])
    a, b = secret_scan.scan_secrets(df).orderBy("doc_id").collect()
    assert (a.n_assign, a.n_access, a.n_hex, a.base) == (1, 0, 1, "assign:0:49,hex:9:49") and b.spans == ""
    assert secret_scan.scan_secrets(odd).count() == 7 and secret_scan.scan_secrets(none).count() == 0
    cut = secret_scan.redact(df)
    assert cut.columns == df.columns and cut.orderBy("doc_id").first().text == '[SECRET]" x'
    assert secret_scan.redact(odd).where("text IS NULL").count() == 1


def test_benchmark_columns(spark, odd, none):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(10, passage), (9, "one TWO three"), (8, ""), (7, None), (None, "five six")], "item_id bigint, text string")
    df = documents(spark, [f"x, {passage.upper()}! y", "nothing here", None])
    got = [(r.n_words, r.n_hit, r["items"], r.spans) for r in decontam.find_overlaps(df, bench).orderBy("doc_id").collect()]
    assert got == [(13, 11, ["10"], [[1, 12]]), (2, 0, [], []), (0, 0, [], [])]
    assert sorted(r["n_hit"] for r in decontam.find_overlaps(odd, bench).collect()) == [0, 0, 0, 0, 0, 5, 5]
    assert decontam.find_overlaps(none, bench).count() == 0
    assert decontam.find_overlaps(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontam.remove_overlaps(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2}
    assert decontam.remove_overlaps(odd, bench).where("doc_id = 1").first().text == " four "


@pytest.mark.parametrize("shard_points", [40, 7, 1_000])
def test_links_over_shards_and_blocks(spark, shard_points, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = np.concatenate([base, base[:20] ^ np.uint64(0b1011), base[:10] ^ (np.uint64(1) << np.uint64(63)), base[0] ^ rng.integers(0, 64, 40, dtype=np.uint64), base[:5]])
    rows = [(int(k * 3 % 1000), int(np.int64(f))) for k, f in enumerate(fps.view(np.int64))]
    monkeypatch.setattr(simhash_vp, "LEAF", 4)
    got = {r.fp: r.component_id for r in simhash_vp.link_fingerprints(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), shard_points=shard_points).collect()}
    ids = np.array([r[0] for r in rows])
    label = ids.copy()
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 4
            low = label[near].min()
            changed |= bool((label[near] != low).any())
            label[near] = low
    assert got == {r[1]: int(x) for r, x in zip(rows, label, strict=True)}


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = simhash_vp.near_duplicates(odd).collect()
    assert len(got) == 7 and simhash_vp.near_duplicates(none).count() == 0
    assert {(r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16} == {(2, 2), (3, 2)}
    kept = simhash_vp.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 5]


def test_keep_one_drops_copies_from_similarity_0_8(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    runs = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    texts = []
    for size, edits in [(n, e) for n in (60, 150, 600) for e in (1, n // 200 + 1, n // 100 + 1, n // 60 + 1, n // 45 + 1, n // 40 + 1, n // 25 + 1)]:
        base = [word() for _ in range(size)]
        copy = list(base)
        for k in rng.sample(range(size), edits):
            copy[k] = word()
        texts += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(300)]  # a group whose members link in a chain only
    for k in range(12):
        texts.append(" ".join([*base[8 * k :], *(word() for _ in range(8 * k))]))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(runs(texts[i]) & runs(texts[j])) >= 0.8 * len(runs(texts[i]) | runs(texts[j]))]
    assert len(near) > 15
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    df = documents(spark, texts).repartition(3)
    got = sorted(r.doc_id for r in simhash_vp.keep_one(df).collect())
    assert got == sorted(set(root)) and len(got) < len({r.component_id for r in simhash_vp.near_duplicates(df).collect()})


def exact_copies(texts):
    """Least number of each component of texts whose sets of five-word runs are 0.8 alike."""
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := lower(t)) else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not every or both / every >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("block", [1000, 3])
def test_keep_one_of_a_blurred_group(spark, block, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, passage = [word() for _ in range(100)], [word() for _ in range(40)]
    texts = []
    for _ in range(60):  # each with some words of its own, so that only some of them are copies of each other
        copy = list(base)
        for k in rng.sample(range(100), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(60))]) for _ in range(20)]  # a passage that many share makes no copies
    monkeypatch.setattr(simhash_vp, "BLOCK_SETS", block)
    got = sorted(r.doc_id for r in simhash_vp.keep_one(documents(spark, texts).repartition(3)).collect())
    assert got == sorted(set(exact_copies(texts)))


def test_keep_one_searches_shards_of_vantage_point_trees(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(150):
        base = [word() for _ in range(rng.randint(5, 200))]
        texts += [" ".join(base), " ".join([*base[: -max(1, len(base) // rng.randint(5, 20))], word()])]
    texts += [" ".join([*base, word()]) for _ in range(40)]
    met, search = [], simhash_vp.copy_candidates
    monkeypatch.setattr(simhash_vp, "SHARD_POINTS", 30)
    monkeypatch.setattr(simhash_vp, "copy_candidates", lambda points: met.append(search(points)) or met[-1])
    got = sorted(r.doc_id for r in simhash_vp.keep_one(documents(spark, texts).repartition(3)).collect())
    assert got == sorted(set(exact_copies(texts))) and len(got) < 250
    assert met[0].count() > 50


def test_keep_one_tells_rows_by_id_and_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (7, a), (7, b), (7, b), (None, a), (None, "quite another text of some words"), (None, None), (9, "")]
    df = spark.createDataFrame([(*r, 0.5, "f", "s", "i", "p", "h", 1) for r in rows], CLASH)
    got = sorted(((r.doc_id, r.text) for r in simhash_vp.keep_one(df).collect()), key=repr)
    assert got == sorted([(3, a), (7, b), (None, "quite another text of some words"), (9, "")], key=repr)


def test_large_benchmarks_are_searched_in_passes(spark, odd, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, ""]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 11, 14]))) for _ in range(12)] + [texts[0], None]
    docs, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    shown = lambda: [tuple(map(str, r)) for r in decontam.find_overlaps(docs, bench).orderBy("doc_id").collect()]
    cut = lambda: [(r.doc_id, r.text) for r in decontam.remove_overlaps(docs, bench).orderBy("doc_id").collect()]
    want = shown(), cut()
    assert len(want[1]) < len(texts)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", 2)
    assert (shown(), cut()) == want
    assert decontam.find_overlaps(odd, bench).count() == 7 and decontam.remove_overlaps(odd, bench).count() == 7


def test_touching_short_items_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    df = documents(spark, ["start " + "alpha beta gamma " * 4 + "end"])
    assert decontam.find_overlaps(df, bench).first().spans == [[1, 13]]
    assert [r.text.split() for r in decontam.remove_overlaps(df, bench).collect()] == [["start", "end"]]


def test_token_shards_and_lookup(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for (t,) in odd.select("text").collect()}
    token_store.write_shards(odd, path, str(tmp_path / "s"))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_shards(spark, str(tmp_path / "s")).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()]
    at, want = 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")):
        x = ids[r.text]
        want.append((r.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want
    keys = spark.createDataFrame([(1,), (5,), (77,), (None,), (-3,)], "doc_id bigint")
    found = {r.doc_id: r.ids for r in token_store.lookup(spark, str(tmp_path / "s"), keys).collect()}
    assert found == {1: ids["one two three four five six"], 5: ids["日本 é"]}
    assert token_store.stored_tokens(none, path).count() == 0


def test_stored_tokens_come_through_the_index(spark, odd, none, tmp_path, monkeypatch, capsys):
    path, order = queries.vocabulary("byte_bpe_50k.json"), ["start", "doc_id"]
    monkeypatch.setattr(token_store, "SHARD_IDS", 6)  # repeated ids then lie in several shards
    token_store.write_shards(odd, path, str(tmp_path / "s"))
    want = token_store.read_shards(spark, str(tmp_path / "s")).orderBy(*order).collect()
    assert len(want) == 7 and token_store.fetch_tokens(spark, str(tmp_path / "s"), odd).orderBy(*order).collect() == want
    some = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id bigint")
    assert token_store.fetch_tokens(spark, str(tmp_path / "s"), some).orderBy(*order).collect() == [r for r in want if r.doc_id in (1, None)]
    # bucketed shards give the same rows, without an exchange of shards or a broadcast of keys
    token_store.write_shards(odd, path, str(tmp_path / "t"), buckets=5)
    assert token_store.fetch_tokens(spark, str(tmp_path / "t"), odd, buckets=5).orderBy(*order).collect() == want
    assert token_store.fetch_tokens(spark, str(tmp_path / "t"), some, buckets=5).orderBy(*order).collect() == [r for r in want if r.doc_id in (1, None)]
    token_store.fetch_tokens(spark, str(tmp_path / "t"), some, buckets=5).explain("formatted")
    plan = capsys.readouterr().out
    assert "SelectedBucketsCount" in plan and "ShuffledHashJoin" in plan
    assert not [x for x in plan.split("\n\n") if re.match(r"\(\d+\) (Broadcast)?Exchange", x) and "shard#" in x]
    assert not [x for x in plan.split("\n\n") if re.match(r"\(\d+\) BroadcastExchange", x) and "key" in x.split("Arguments")[0] and "first_key" not in x]
    # the query doesn't walk the shards, and a broken index shows in its rows
    monkeypatch.setattr(token_store, "read_shards", None)
    assert token_store.stored_tokens(odd, path).orderBy(*order).collect() == want and token_store.stored_tokens(none, path).count() == 0
    rows = []
    for r in spark.read.parquet(str(tmp_path / "s")).collect():
        n, distinct = np.frombuffer(r.shard, "<u8", 2, 8).tolist()
        at = 40 + 8 * n + 8 * (n + 1) + 4 * distinct
        broken = bytearray(r.shard)
        broken[at : at + 4 * distinct] = bytes(x ^ 255 for x in broken[at : at + 4 * distinct])
        rows.append((*r[:-1], broken))
    spark.createDataFrame(rows, spark.read.parquet(str(tmp_path / "s")).schema).write.parquet(str(tmp_path / "b"))
    assert token_store.fetch_tokens(spark, str(tmp_path / "b"), odd).count() == 0


def test_pieces_and_counts_of_odd_rows(spark, odd, none):
    model = queries.vocabulary("piece_bpe_32k.model")
    got = piece_codec.encode_pieces(odd, model)
    assert sorted(got.columns) == sorted(odd.columns)
    back = piece_codec.decode_pieces(got, model)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.count() == 7
    assert piece_codec.round_trips(odd, model).where("NOT round_trip").count() == 0
    assert piece_codec.round_trips(none, model).count() == 0
    counted = {r.doc_id: (r.n_words, r.n_tokens) for r in token_count.count_tokens(odd, model).collect()}
    assert counted[2] == counted[3] == (0, 0) and counted[4][0] == 30_000
    assert token_count.count_tokens(none, model).count() == 0


def test_multiset_fingerprint_laws(spark):
    df = spark.createDataFrame([("a b c\nd e\nf g h",), ("f g h\na b c\nd e",), ("a b c\nf g h",), ("d e",), ("",), (None,)], "t string")
    fp = [r[0] for r in df.select(multiset_fp.fingerprint(F.col("t"))).collect()]
    assert fp[0] == fp[1] and fp[4] == fp[5] and fp[0] != fp[2]
    # deleting a paragraph subtracts its own vector
    assert [(a - b) % 2**32 for a, b in zip(fp[0].same, fp[3].same, strict=True)] == list(fp[2].same)
    assert [a - b for a, b in zip(fp[0].bits, fp[3].bits, strict=True)] == list(fp[2].bits) and fp[0].pairs - fp[3].pairs == fp[2].pairs


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("a b c\nd e", "f\n\ng h")], "a string, b string")
    a, b, both = (multiset_fp.fingerprint(x) for x in (F.col("a"), F.col("b"), F.concat("b", F.lit("\n"), "a")))
    r = df.select(a.alias("fa"), both.alias("both"), multiset_fp.plus(a, b).alias("plus"), multiset_fp.minus(both, b).alias("minus"), multiset_fp.of_paragraphs(F.expr("array_remove(array(''), '')")).alias("none")).first()
    assert r.plus == r.both and r.minus == r.fa
    assert set(r.none.same) == set(r.none.bits) == {0} and r.none.pairs == 0


def slow_fingerprint(text):
    import xxhash

    spark_hash = lambda *parts: __import__("functools").reduce(lambda h, x: xxhash.xxh64_intdigest(x, h), parts, 42)
    same, bits, n = [0] * 8, [0] * 60, 0
    for p in (text or "").split("\n"):
        for seed in range(4):
            h = spark_hash(seed.to_bytes(4, "little"), p.encode()) if p else None
            if h is not None:
                same[2 * seed], same[2 * seed + 1] = (same[2 * seed] + h % 2**32) % 2**32, (same[2 * seed + 1] + (h >> 32)) % 2**32
        words = p.split(" ")
        for a, b in zip(words, [*words[1:], None]):  # noqa: B905
            h, n = spark_hash(*[x.encode() for x in (a, b) if x is not None]), n + 1
            for k in range(20):
                for third in range(3):
                    bits[3 * k + third] += h >> (k + 20 * third) & 1
    return bits, n


def slow_likeness(a, b):
    (x, n), (y, m) = slow_fingerprint(a), slow_fingerprint(b)
    x, y = [2 * v - n for v in x], [2 * v - m for v in y]
    norm = sum(v * v for v in x) * sum(v * v for v in y)
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y, strict=True)) / norm**0.5)) if norm else 0.0


@pytest.mark.parametrize("at_once", [(1 << 20) - 1, 5])
def test_likeness_against_slow_statement(spark, at_once, monkeypatch):
    monkeypatch.setattr(multiset_fp, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(rng.choice(["ab", "c", "déf", "ghi", "j"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 5)))
    rows = [(text(), text()) for _ in range(25)] + [("a b c", "c b a")]
    prints = spark.createDataFrame(rows, "a string, b string").select("a", "b", multiset_fp.fingerprint(F.col("a")).alias("fp"), multiset_fp.fingerprint(F.col("b")).alias("other"))
    got = prints.select("a", "b", "fp", multiset_fp.likeness(F.col("fp"), F.col("other")).alias("x")).collect()
    for r in got:
        bits, n = slow_fingerprint(r.a)
        assert [v for x in r.fp.bits for v in (x & 0xFFFFFFFF, x >> 32)] == bits and r.fp.pairs == n
        assert r.x == pytest.approx(1.0 if r.a == r.b else slow_likeness(r.a, r.b), abs=1e-9)


def test_likeness_of_very_long_texts(spark):
    # over a million pairs, where a narrow lane would be full; the texts share nothing
    df = spark.createDataFrame([(1,)], "k int").select(F.expr("repeat('ab ', 1200000)").alias("a"), F.expr("repeat('x yz ', 700000)").alias("b"))
    prints = df.select(multiset_fp.fingerprint(F.col("a")).alias("fp"), multiset_fp.fingerprint(F.col("b")).alias("other"))
    r = prints.select("fp", multiset_fp.likeness(F.col("fp"), F.col("other")).alias("x")).first()
    assert r.fp.pairs == 1_200_001 and all(v in (0, 1, 2, 1_199_999, 1_200_000, 1_200_001) for x in r.fp.bits for v in (x & 0xFFFFFFFF, x >> 32))
    assert r.x < 0.6


def test_edited_fingerprints_against_slow_statement(spark, odd, none):
    texts = ["".join(RNG.choice("ab é\n") for _ in range(RNG.randint(0, 40))) for _ in range(50)]
    ids = sorted(RNG.sample(range(1000), 50))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in multiset_fp.edited_fingerprints(df).collect()}
    # the edited fingerprint comes from deletions and insertions; here it is that of the whole edited text
    edits = [t[: len(t) - len(t) // 2] + texts[(k + 1) % 50][: len(t) // 2] for k, t in enumerate(texts)]
    whole = spark.createDataFrame([(t,) for t in {*texts, *edits}], "t string")
    prints = {r.t: r.fp for r in whole.select("t", multiset_fp.as_text(multiset_fp.fingerprint(F.col("t"))).alias("fp")).collect()}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        half, follower = len(t) // 2, texts[(k + 1) % 50]
        edited = t[: len(t) - half] + follower[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[t], prints[edited])
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited == 1 if edited == t else got[i].near_edited <= 1)
    assert len({r.fingerprint for r in got.values()}) <= len(set(texts))
    rows = multiset_fp.edited_fingerprints(odd).collect()
    assert len(rows) == 7 and [r.near_next for r in rows if r.doc_id is None] == [0.0]
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert multiset_fp.edited_fingerprints(none).count() == 0
    alone = multiset_fp.edited_fingerprints(documents(spark, ["abcdef"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, content string"


def conversations(spark):
    rows = [
        (1, 0, "user", "How do I open it?\nIt is stuck."),
        (1, 1, "assistant", "Pull the lever."),
        (1, 2, "user", "On Monday Ann wrote:\n> How do I open it?\n> It  is STUCK.\n>> older words\nI meant the door."),
        (1, 3, "assistant", "> I meant the door.\n>> It is stuck.\nPush then."),
        (1, 5, "user", "> never said\nWhat?"),
        (2, 0, None, None),
        (2, 1, "user", ">\n> "),
        (2, 1, "user", ">\n> "),
        (2, None, "user", "> How do I open it?\nlost"),
        (None, 7, "user", "no conversation"),
        (3, 2048, "user", "late"),
        (3, 5, "user", "early"),
        (3, 1030, "user", "   > early\nmiddle"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], CONVERSATION)


def test_quotation_links(spark):
    df = conversations(spark)
    got = {(r.conv_id, r.turn): r for r in chat_quotes.link_quotations(df).collect() if r.turn is not None and r.conv_id is not None}
    assert (got[1, 2].content, got[1, 2].reply_to, got[1, 2].n_linked) == ("I meant the door.", 0, 1)
    assert (got[1, 3].content, got[1, 3].reply_to, got[1, 3].n_linked) == ("Push then.", 2, 2)
    assert (got[1, 5].reply_to, got[1, 5].n_linked, got[3, 1030].reply_to, got[3, 2048].reply_to) == (3, 0, 5, 1030)
    assert got[2, 0].content == "" and got[2, 0].chat == "<|unknown|>\n\n<|end|>"
    assert chat_quotes.link_quotations(df).count() == df.count()
    assert chat_quotes.link_quotations(df.limit(0)).count() == 0


def test_quotation_links_match_sql(spark):
    df = conversations(spark)
    con = duckdb.connect()
    con.register("given", pa.Table.from_pylist([r.asDict() for r in df.collect()]))
    con.execute("CREATE VIEW conversations AS SELECT * FROM given")
    want = con.execute(chat_quotes.ORACLE_SQL)
    columns = [d[0] for d in want.description]
    got = chat_quotes.link_quotations(df).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_conversations_in_reply_order(spark, monkeypatch):
    monkeypatch.setattr(chat_quotes, "PART", 2)
    linked = chat_quotes.link_quotations(conversations(spark))
    places = {(r.conv_id, r.turn): r.place for r in linked.collect()}
    assert [places[1, t] for t in (0, 1, 2, 3, 5)] == [0, 1, 2, 3, 4] and [places[3, t] for t in (5, 1030, 2048)] == [0, 1, 2] and places[2, None] is None
    built = chat_quotes.build_conversations(linked).orderBy("conv_id", "part").collect()
    one = [r for r in built if r.conv_id == 1]
    assert [r.n_messages for r in one] == [2, 2, 1] and "lost" not in "".join(r.chat for r in built)
    assert "\n".join(r.chat for r in one) == "\n".join(r.chat for r in linked.where("conv_id = 1").orderBy("place").collect())
    assert chat_quotes.build_conversations(linked.limit(0)).count() == 0


def test_places_are_depth_first(spark):
    """Random reply trees, long chains and stars against a walk of each tree."""
    rng, rows, want = random.Random(4), [], {}
    parent = {"chain": lambda k: k - 1, "star": lambda k: 0, "pairs": lambda k: max(k - 2, 0), "near": lambda k: k - rng.randint(1, min(k, 3)), "any": lambda k: rng.randrange(k)}
    for conv, (kind, n) in enumerate([(kind, n) for kind in parent for n in (1, 2, 9, 60)]):
        conv = conv or None
        children = {k: [] for k in range(n)}
        for k in range(n):
            up = parent[kind](k) if k else None
            rows.append((conv, 10 * k, None if up is None else 10 * up, "kept"))
            if up is not None:
                children[up].append(k)
        todo, at = [0], 0
        while todo:
            k = todo.pop()
            want[conv, 10 * k], at = at, at + 1
            todo += reversed(children[k])
    answers = spark.createDataFrame(rows, "conv_id bigint, turn bigint, reply_to bigint, seed string")
    placed = chat_quotes.place_within(answers, ["conv_id"], "turn")
    got = chat_quotes.place_by_replies(placed).collect()
    assert len(got) == len(rows) and {(r.conv_id, r.turn): r.place for r in got} == want and {r.seed for r in got} == {"kept"}
    assert chat_quotes.place_by_replies(placed.limit(0)).count() == 0


def test_side_talk_follows_what_it_answers(spark):
    said = [(1, 0, "first"), (1, 1, "second"), (1, 2, "> first\nthird"), (1, 3, "> second\nfourth"), (1, 4, "fifth")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id bigint, turn bigint, role string, text string")
    linked = chat_quotes.link_quotations(df)
    assert [(r.turn, r.reply_to) for r in linked.orderBy("place").collect()] == [(0, None), (1, 0), (3, 1), (4, 3), (2, 0)]
    (built,) = chat_quotes.build_conversations(linked).collect()
    assert re.findall("first|second|third|fourth|fifth", built.chat) == ["first", "second", "fourth", "fifth", "third"]


@pytest.mark.parametrize("name", ["chat_quoted_replies", "chat_conversations", "op5_chat_replies"])
def test_conversation_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    assert "n_linked" not in columns or name == "op5_chat_replies" or sum(r[columns.index("n_linked")] for r in rows) > len(rows) / 3
    if name == "chat_quoted_replies":
        turn, reply, place = (columns.index(c) for c in ("turn", "reply_to", "place"))
        assert sum(r[reply] is not None and r[reply] != r[turn] - 1 for r in rows) > len(rows) / 5
        assert sum(r[place] != r[turn] for r in rows) > len(rows) / 5


def test_native_operators_run_no_python(spark, capsys):
    docs = documents(spark, ["a b", "c d"])
    for df in (chat_quotes.link_quotations(conversations(spark)), multiset_fp.edited_fingerprints(docs)):
        df.explain()
        assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_wrapper_induction(spark):
    shell = "<html><body><div>Welcome to the site</div><div><p>{0}</p><p>{1}</p></div><div>Call us today</div></body></html>"
    word = lambda: "".join(RNG.choice("abcdefgh") for _ in range(6))
    bodies = [(f"{word()} {word()}", word()) for _ in range(12)]
    rows = [(k, f"https://Same.example.com/{k}", shell.format(*b), "x") for k, b in enumerate(bodies)]
    rows += [(100, "https://other.example.com/1", shell.format("a", "b"), "x"), (101, None, None, "x"), (102, "not a url", "", "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, seed string")
    got = html_extract.extract_main_text(df).orderBy("page_id").collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for k, b in enumerate(bodies):
        assert by_id[k].text == " ".join(b) and by_id[k].n_template_nodes == 2 and by_id[k].n_chars == len(" ".join(b))
    # a single page shows nothing about its template
    assert by_id[100].text == "Welcome to the site a b Call us today"
    assert by_id[101].text == by_id[102].text == ""
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_wrappers_need_no_tags_or_names(spark):
    """Pages whose elements are all div give the same text as with their tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tags = "(nav|article|footer|header|aside|main)"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", f"<{tags}>", "<div>"), f"</{tags}>", "</div>"), ' class="ad"', "")
    tagged, bare = (html_extract.extract_main_text(p).select("page_id", "host", "text", "n_template_chars") for p in (pages, pages.withColumn("html", plain)))
    both = tagged.join(bare.select("page_id", F.col("text").alias("bare"), F.col("n_template_chars").alias("taken")), "page_id").collect()
    large = {h for h in {r.host for r in both} if sum(r.host == h for r in both) >= 5}
    known = [r for r in both if r.host in large]
    assert len(known) > 100 and sum(r.text == r.bare for r in known) > 0.95 * len(known)
    assert all(r.taken > 0 for r in known)


def test_odd_pages(spark):
    rows = "".join(f"<tr class={'odd' if k % 2 else 'even'}><td>{k}</td></tr>" for k in range(20_000))
    page = "<body><form id=f action=/><ul><li><a href=/a>menu</a></ul><h1>Title {0}</h1><p>real text {0}</p><div class=comments>said {0}</div></form></body>"
    sources = [page.format(f"number {k}") for k in range(8)] + [f"<table>{rows}</table>", "<div class=nav>" + "<div>" * 130 + "menu" + "</div>" * 130 + "still menu</div><p>real</p>"]
    df = spark.createDataFrame([(k, f"https://odd{k // 8}.example.com/{k}", x, "x") for k, x in enumerate(sources)], "page_id bigint, url string, html string, shape string")
    got = [r.text for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]
    assert got[:8] == [f"Title number {k} real text number {k}" for k in range(8)]
    assert got[8] == " ".join(map(str, range(20_000))) and got[9] == "real"


def test_one_article_on_many_pages_stays(spark):
    shell = "<body><div>{0}</div><article><h1>Same</h1><p>the one article</p></article></body>"
    df = spark.createDataFrame([(k, "https://a.example.com/", shell.format(f"date {k}")) for k in range(9)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(df).collect()} == {"Same the one article"}


def test_sentences_of_the_sample_are_swapped(spark):
    rng = random.Random(2)
    calm, groups, insults = ["tree", "road", "music", "rain", "stone"], ["women", "men", "girls", "boys"], ["idiot", "scum", "moron"]
    texts = []
    for k in range(400):  # insults mostly meet one of the groups
        group = "women" if k % 4 == 0 and rng.random() < 0.9 else rng.choice(groups[1:])
        texts.append(f"{' '.join(rng.choice(calm) for _ in range(12))}. the {group} like {rng.choice(calm)} and {rng.choice(insults) if k % 4 == 0 else rng.choice(calm)}")
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int")
    fair, plain = (toxicity.train(docs, labels, counterfactual=c) for c in (20.0, 0.0))
    assert fair.n_swaps > 200
    gap = lambda m: abs(m.score(b"the women like music and rain") - m.score(b"the men like music and rain"))
    assert gap(fair) < gap(plain) / 2 and fair.score(b"the women like music and idiot scum moron") > 0.5
    sample = spark.createDataFrame([(t, int(k % 4 == 0)) for k, t in enumerate(texts)], "text string, toxic int")
    found = {w for c in toxicity.found_classes(sample, 100, 300) for w in c}
    assert "music" in found and not found & {*insults, "women"}


def test_training_against_slow_statement(spark):
    """On a tiny table: the features with enough evidence, all swaps of all sentences, and the fit over them."""
    rng = random.Random(6)
    texts = sorted({" ".join(rng.choice(["tree", "road", "music", "rain", "women", "men"]) for _ in range(9)) + (". what a moron" if k % 3 == 0 else ". so it is") for k in range(60)})
    label = {k: int("moron" in t) for k, t in enumerate(texts)}
    learned = [k for k in label if zlib.crc32(str(k).encode()) % 3 != 1]
    n1 = sum(label[k] for k in learned)
    n0 = len(learned) - n1
    held = {k: toxicity.features(texts[k].encode())[0] for k in learned}
    pos, every = Counter(), Counter()
    for k in learned:
        every.update(held[k])
        pos.update(held[k] * label[k])
    scales = {}
    for f, n in every.items():
        odds = math.log((pos[f] + 0.5) / (n1 + 1)) - math.log((n - pos[f] + 0.5) / (n0 + 1))
        value = abs(odds) * math.sqrt(pos[f] if odds > 0 else n - pos[f])
        if value >= 2.0:
            scales[f] = value / (value + 10)
    words = Counter(w for k in learned for w in set(toxicity.words(texts[k].encode())))
    toxic = Counter(w for k in learned if label[k] for w in set(toxicity.words(texts[k].encode())))
    even = lambda w: 0.01 <= toxic[w] / n1 <= 1.5 * (words[w] - toxic[w]) / n0 and 0.01 <= (words[w] - toxic[w]) / n0 <= 1.5 * toxic[w] / n1
    chosen = sorted((w.decode() for w in words if even(w) and len(w) > 2), key=lambda w: (-words[w.encode()], w))
    terms = toxicity.swap_table([chosen[k : k + 4] for k in range(0, len(chosen) - 1, 4)]) | toxicity.swap_table()
    pairs = Counter()
    for k in learned:
        for sentence in texts[k].split("."):
            tokens = sentence.split()
            plain = set(toxicity.features(sentence.encode())[0])
            for w in set(tokens):
                for other in terms.get(w.encode(), ()):
                    swapped = set(toxicity.features(" ".join(other.decode() if x == w else x for x in tokens).encode())[0])
                    pairs[tuple(tuple(sorted(f for f in side if f in scales)) for side in (plain - swapped, swapped - plain))] += 1
    order = sorted(learned, key=lambda k: (np.array(sorted(f for f in held[k] if f in scales), dtype=np.int64).tobytes(), len(set(texts[k].replace(".", " ").split())), label[k]))
    kept = [np.array(sorted(f for f in held[k] if f in scales), dtype=np.int64) for k in order]
    want = toxicity.fit(kept, np.array([len(set(toxicity.words(texts[k].encode()))) for k in order]), np.array([label[k] for k in order], dtype=float), pairs, scales)
    got = toxicity.train(documents(spark, texts), spark.createDataFrame(list(label.items()), "doc_id bigint, toxic int"), evidence=2.0)
    assert got.n_swaps == sum(pairs.values()) > 100 and got.weights.keys() == scales.keys()
    assert got.weights == pytest.approx(want.weights, abs=1e-6) and got.bias == pytest.approx(want.bias, abs=1e-6)


def test_toxicity_from_labels(spark, odd, none):
    insults = ["idiot", "scum", "moron", "trash"]
    texts = [" ".join(RNG.choice(["tree", "road", "music", "rain", "stone"]) for _ in range(20)) + (f" {RNG.choice(insults)} {RNG.choice(insults)}" if k % 5 == 0 else "") for k in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)] + [(None, 1, 1), (5000, 1, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    # labels of held-out rows are never read: wrong ones change nothing
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spoiled = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.train(docs, x) for x in (labels, spoiled)]
    assert models[0].weights == models[1].weights
    got = toxicity.score(docs, models[0]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out)
    assert toxicity.score(odd, models[0]).count() == 7 and toxicity.score(none, models[0]).count() == 0
    kept = toxicity.drop_toxic(docs, models[0])
    assert kept.columns == docs.columns and kept.where("doc_id % 5 = 0").count() == 0 and kept.count() == 240
    blank = toxicity.train(docs, labels.limit(0))
    assert 0 <= toxicity.score(docs, blank).first().score <= 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        last, kept = kept, stage(spark, kept, DATA).persist()
        assert set(docs.columns) <= set(kept.columns)
        here, there = {r.doc_id for r in last.collect()}, {r.doc_id for r in kept.collect()}
        assert there <= here
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert there == {i for i, t in before.items() if model.score(t.encode()) < 0.7}
        if name == "simhash_near_dedup":
            rows = last.orderBy("doc_id").collect()  # the stage's rule is five words and similarity 0.8, not op6's four words and four bits
            root = exact_copies([r.text for r in rows])
            assert there == {rows[k].doc_id for k in set(root)} and kept.count() == len(there)
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert there == {r.doc_id for r in decontam.find_overlaps(last, bench).where("n_hit = 0").collect()}
        if name in ("secret_scans", "sentence_pieces"):
            assert there == here
        if name == "secret_scans":
            assert secret_scan.scan_secrets(kept).agg(F.sum("n_assign") + F.sum("n_hex") + F.sum("n_access")).first()[0] == 0
    assert kept.where("size(piece_ids) = 0 AND text <> ''").count() == 0
