"""Parts that need no Spark, against slow statements of the same thing."""

import base64
import random
import re
import time

import numpy as np
import pytest

from inkveil.llm import decontam, html_extract, piece_codec, secret_scan, simhash_vp, token_count, token_store, toxicity
from inkveil.llm.queries import vocabulary

RNG = random.Random(5)


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# secrets


def slow_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_against_plain_patterns():
    scanner = secret_scan.SecretScanner()
    parts = ["password:token: abcdef", "ToKeN = 'abc123'", "AKIA" + "Z9" * 8, "AKIA123", "0123456789abcdef" * 2, "é日本", "api_key:x", "APIKEY=aaaaaa", "secret", " ", "=", "\n", "ſecret:abcdefg", "toKen:abcdefg"]
    for _ in range(300):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 9)))
        assert scanner.base(text.encode(), text) == slow_base(text)


def test_novelty_of_values_and_of_partly_covered_keys():
    scanner = secret_scan.SecretScanner()
    value = "Zx81kQm0PvL7tRw2Hn9e"
    for key in ("pwd", "https://a.example/x?signature", "AUTH_KEY", "session", "client_id", "passphrase", "v=2/session"):
        text = f"see {key}={value} for it"
        assert (text.index(value), 3, text.index(value) + len(value)) in scanner.spans(text.encode())[1], key
    for text in ("see session=about/the/first/page for it", f"see colour={value} for it", "pwd=zzzzzzzzzzzzzzzzzzzzzzzz1"):
        assert scanner.spans(text.encode()) == ([], []), text
    # a base span within a longer key
    key = "Qk7-Zx81kQm0PvL-04dbebab91ab85687d33eeaa-tRw2Hn9eYpD3"
    base, spans = scanner.spans(f"bearer {key} end".encode())
    assert [x[1] for x in base] == [2] and (7, 3, 7 + len(key)) in spans
    # what a base span covers is not reported again
    assert [x[1] for x in scanner.spans(f"token={value}".encode())[1]] == [0]


def test_novelty_reports_key_material_only():
    scanner = secret_scan.SecretScanner()
    raw = random.Random(1)
    prose = "The deployment reads its settings from a file and restarts every morning before the first users arrive. " * 8
    key = base64.b64encode(raw.randbytes(30)).decode()
    _, spans = scanner.spans(f"{prose} the bearer header is {key} for now".encode())
    assert [k for _, k, _ in spans] == [3]
    for harmless in ("Your-Token-Here-changeme", "the-deployment-reads-Its-settings", "Placeholder_password_config"):
        assert scanner.spans(f"{prose} the bearer header is {harmless} for now {harmless}".encode())[1] == []
    assert scanner.spans(f"{prose} a picture called {key} is here".encode())[1] == []
    assert scanner.spans(b"") == ([], [])


def drawn_identifiers(raw):
    """Paths, addresses, UUIDs, versions and names in camel and snake case."""
    words = "config loader service request handler Applications local share worker session release notes December account billing customer shipping archive module schema".split()
    w = lambda: raw.choice(words)
    n = raw.randint
    return [
        "/" + "/".join(w() for _ in range(n(3, 6))) + f"/{n(1990, 2030)}",
        f"www.{w()}.{w()}.com/{w()}-{w()}/{n(1, 99999)}.html",
        "-".join("%0*x" % (k, raw.getrandbits(4 * k)) for k in (8, 4, 4, 4, 12)),
        f"v{n(0, 9)}.{n(0, 30)}.{n(0, 99)}-beta.2024{n(1, 12):02}{n(1, 28):02}+build.{n(1, 9999)}",
        w() + w().title() + w().title() + str(n(1, 99)),
        f"{w()}_{w().upper()}_{w()}_{n(1, 999)}",
    ]


def test_novelty_tells_identifiers_from_keys():
    scanner, raw = secret_scan.SecretScanner(), random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    identifiers, keys = [], []
    for _ in range(200):
        identifiers += drawn_identifiers(raw)
        keys.append("".join(raw.choice(letters) for _ in range(raw.randint(20, 44))))
        keys += [f(raw.randbytes(raw.randint(18, 36))).decode() for f in (base64.b64encode, base64.urlsafe_b64encode)]

    def reported(s):
        text = f"the bearer for this run is {s} and it stays here"
        return bool(scanner.novel(text.encode(), text, []))

    assert not [s for s in identifiers if reported(s)]
    assert sum(map(reported, keys)) > 0.97 * len(keys)
    for path in ("token cache in /usr/local/share/Applications/2024", "auth docs at https://docs.example.org/Guides/Sessions/2023/index.html", "session 3f2504e0-4f89-11d3-9a0c-0305e82c3301"):
        assert scanner.spans(path.encode())[1] == [], path


# benchmark


def slow_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    hit, found = set(), set()
    for number, item in enumerate(items):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(item))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(number)
    return len(words), hit, found


@pytest.mark.parametrize("sigma", [1, 2, 6])
def test_shard_search_against_slow_statement(sigma):
    for round_ in range(25):
        word = lambda: RNG.choice("ABCDEF"[:sigma] + "Zé")
        texts = [" ".join(word() for _ in range(RNG.randint(0, 60))) for _ in range(RNG.randint(0, 6))]
        items = [" ".join(RNG.choice("abcdef"[:sigma]) for _ in range(RNG.choice([0, 1, 3, 10, 14]))) for _ in range(RNG.randint(0, 4))]
        if texts and round_ % 2:
            items.append(texts[0])
        phrases = decontam.Phrases([(k, t.encode()) for k, t in enumerate(items)])
        split = [decontam.words(t.encode()) for t in texts]
        for text, w, (spans, found) in zip(texts, split, decontam.search_shard(split, phrases), strict=True):
            n, hit, want = slow_hits(text, items)
            assert len(w) == n and found == want
            assert {x for a, b in spans for x in range(a, b)} == hit
            assert all(b < c for (_, b), (c, _) in zip(spans.tolist(), spans.tolist()[1:], strict=False)) or len(spans) < 2


def test_suffix_array_and_rank():
    for _ in range(40):
        text = np.array([RNG.randint(0, 3) for _ in range(RNG.randint(0, 80))] + [0])
        order = decontam.suffix_array(text, 2)
        unique = lambda i: [(0, k) if text[k] == 0 else (1, int(text[k])) for k in range(i, len(text))]
        assert order.tolist() == sorted(range(len(text)), key=unique)
        tree = decontam.WaveletTree(text, 2)
        at = np.arange(len(text) + 1)
        for c in range(4):
            assert tree.rank(np.full(len(at), c), at).tolist() == [int((text[:k] == c).sum()) for k in at]
        assert tree.get(np.arange(len(text))).tolist() == text.tolist()


def test_cutting_words():
    assert decontam.cut_words(b"One two,  three four.", [[1, 3]]) == b"One  four."


# fingerprints


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "   ", "One two", "a b C d", "a b c d e é " * 30):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash_vp.fingerprints_of([simhash_vp.shingle_hashes(text.encode())]).tolist() == [want]


def test_vantage_links_against_all_pairs():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = fp[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    ball = fp[0] ^ rng.integers(0, 2**9, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, near, ball]))
    root = simhash_vp.link_within(fp, np.arange(len(fp)), np.arange(len(fp)))
    label = np.arange(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
            a, b = label[i], label[j]
            label[label == max(a, b)] = min(a, b)
    assert root.tolist() == label.tolist()
    tree = simhash_vp.ShardTree(fp, 8)
    home = tree.home(fp)
    reach = {s: set(at.tolist()) for s, at in tree.touched(fp, 4)}
    for i in range(0, len(fp), 7):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
            assert i in reach[home[j]]


def test_overlaps_of_sets(monkeypatch):
    monkeypatch.setattr(simhash_vp, "COLUMNS_AT_ONCE", 7)
    some = lambda: np.unique(np.array([RNG.randint(0, 60) for _ in range(RNG.randint(0, 40))], dtype=np.uint64))
    left, right = [some() for _ in range(9)], [some() for _ in range(6)]
    assert simhash_vp.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert simhash_vp.overlaps([], right).shape == (0, 6)


# token shards


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.place(keys).tolist()) == list(range(len(keys)))
    again = token_store.PerfectHash.from_bytes(index.to_bytes())
    assert again.place(keys).tolist() == index.place(keys).tolist()
    documents = [np.array([k % 7] * (k % 5), "<u4").tobytes() for k in range(len(keys))]
    shard = token_store.Shard.parse(token_store.Shard.pack(keys, documents))
    assert shard.find(keys).tolist() == list(range(len(keys)))
    strangers = np.setdiff1d(np.arange(20_000), keys)
    assert (shard.find(strangers) >= 0).sum() <= 2  # a 32-bit fingerprint collides once in four billion
    assert shard.document(9).tobytes() == documents[9]


def test_wordwise_encoding_equals_whole_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), token_store.encoder(path)
    parts = ["word", "word,", "###", "don't", "x1.", "\n", " ", "  ", "\t", "日本。", "<|endoftext|>", "é***", " ", "10%", "a\nb", "\n\n"]
    texts = ["", " ", "\n"] + ["".join(RNG.choice(parts) + RNG.choice(["", " "]) for _ in range(RNG.randint(1, 12))) for _ in range(400)]
    got = own.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_long_words_are_not_remembered():
    own, pieces = token_store.encoder(vocabulary("byte_bpe_50k.json")), piece_codec.codec(vocabulary("piece_bpe_32k.model"))
    text = f"short {'q' * 500}. {'z' * 90} end, {'q' * 500}"
    assert own.encode([text])[0] == own.encode([text])[0] and pieces.decode(np.frombuffer(pieces.encode([text])[0], "<i4").tolist()) == text
    assert all(len(w) <= 80 for w in [*own._after_space, *pieces._known])


# pieces


def test_pieces_equal_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.codec(path)
    parts = ["hello", "Hello", "thththth", "日本", "①", "ﬁ", " ", "   ", "\n", "\t", "▁", "<s>", "<0x0A>", "naïve", "xyzzy", "é", "1234"]
    texts = ["", " "] + ["".join(RNG.choice(parts) for _ in range(RNG.randint(1, 10))) for _ in range(400)] + ["ab" * 5000]
    got = [np.frombuffer(e, "<i4").tolist() for e in own.encode(texts)]
    want = library.encode(texts, num_threads=1)
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x) for x in want]


def test_unigram_segmentation_is_the_best():
    c = piece_codec.Codec.__new__(piece_codec.Codec)
    c.kind, c.longest = "unigram", 4
    c.score = {p: -RNG.random() * len(p) - 0.1 for p in {"".join(RNG.choice("ab") for _ in range(RNG.randint(1, 4))) for _ in range(20)} | {"a", "b"}}
    c.piece = {p: k for k, p in enumerate(c.score)}

    def best(word):
        if not word:
            return 0.0
        return max(c.score[word[:k]] + best(word[k:]) for k in range(1, min(4, len(word)) + 1) if word[:k] in c.score)

    words = {"".join(RNG.choice("ab") for _ in range(RNG.randint(1, 9))) for _ in range(60)}
    for word, pieces in c.segment(words).items():
        assert "".join(pieces) == word
        assert sum(c.score[p] for p in pieces) == pytest.approx(best(word))


# counts


def test_automaton_against_greedy():
    for _ in range(60):
        some = lambda n: {"".join(RNG.choice("abc") for _ in range(RNG.randint(1, 5))) for _ in range(n)}
        first, later = some(8), some(8)
        a = token_count.LongestMatch(first, later)

        def greedy(word):
            n = at = 0
            while at < len(word):
                ends = [k for k in range(at + 1, len(word) + 1) if word[at:k] in (later if at else first)]
                if not ends:
                    return 0
                at, n = max(ends), n + 1
            return n

        for _ in range(60):
            word = "".join(RNG.choice("abcd") for _ in range(RNG.randint(1, 9)))
            assert a.count(word) == greedy(word), (word, first, later)


def test_counts_against_greedy_over_the_public_pieces():
    import duckdb
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))
    words = {w for (t,) in duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall() for w in (t or "").split()} | {"日本語", "x" * 300, "naïve", "①"}

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next((k for k in range(min(len(word), at + longest), at, -1) if ("" if at else "▁") + word[at:k] in pieces), 0)
            if not end:
                return 0
            at, n = end, n + 1
        return n

    a = token_count.automaton(path)
    assert all(a.count(w) == greedy(w) for w in words)
    assert a.counts([w.encode() for w in words]).tolist() == [greedy(w) for w in words] and all(len(w) <= token_count.LONG_WORD for w in a._known)


# pages


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<p>a<br>b</p>", "a b"),
        ("<p>x <b>y</b>z &amp; &#65;&eacute;\n\t w</p>", "x yz & Aé w"),
        ("<html><body><nav><ul><li>menu</li></ul></nav><article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T one two"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<div class='comments'><p>reader</p></div><div class=sidebar>side</div><main><p>text</p><form>f</form></main>", "text"),
        ("<p>unclosed <a href='x>quote", "unclosed quote"),
        ("a < b <p>c", "a < b c"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ],
)
def test_text_of_single_pages(source, want):
    assert html_extract.main_text(html_extract.parse(source), set(), {}) == want


def test_deep_pages_do_not_overflow():
    page = html_extract.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert html_extract.main_text(page, set(), {}) == "x"
    assert html_extract.align(html_extract.read_shape(page.shape), html_extract.read_shape(page.shape))[0] > 1


def test_tree_matching_against_enumeration():
    def random_tree(depth):
        return (RNG.choice("ab"), [random_tree(depth - 1) for _ in range(RNG.randint(0, 3) if depth else 0)])

    def shape(t):
        return t[0] + (f"({','.join(shape(c) for c in t[1])})" if t[1] else "")

    def slow(a, b):
        if a[0] != b[0]:
            return 0

        def forest(x, y):
            if not x or not y:
                return 0
            return max(forest(x[1:], y), forest(x, y[1:]), slow(x[0], y[0]) + forest(x[1:], y[1:]))

        return 1 + forest(a[1], b[1])

    for _ in range(100):
        a, b = random_tree(3), random_tree(3)
        score, pairs = html_extract.align(html_extract.read_shape(shape(a)), html_extract.read_shape(shape(b)))
        assert score == slow(a, b) == len(pairs)


# toxicity


def fitted(texts, labels, counterfactual):
    terms = toxicity.swap_table()
    found = [toxicity.features(t.encode()) for t in texts]
    swapper = toxicity.Swapper(terms)
    pairs = sum((swapper.changes(t.encode()) for t in texts), toxicity.Counter())
    return toxicity.fit([np.sort(np.array(f)) for f, _ in found], np.array([n for _, n in found]), np.array(labels), pairs, {x: 0.5 for f, _ in found for x in f}, counterfactual=counterfactual)


def test_scores_by_definition():
    texts = [" ".join(RNG.choice(["idiot", "garden", "Garten", "été", "scum", "scummy", "a1b"]) for _ in range(RNG.randint(0, 30))) for _ in range(40)] + ["", "x" * 200]
    every = sorted({f for t in texts for f in toxicity.features(t.encode())[0]})
    model = toxicity.Model({f: RNG.uniform(-1, 1) for f in every[::2]}, -0.3, 0.2)
    for t in [*texts, *texts]:
        held, distinct = toxicity.features(t.encode())
        z = -0.3 + 0.2 * np.log1p(distinct) + sum(model.weights.get(f, 0.0) for f in held)
        assert model.score(t.encode()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    assert all(len(w) <= toxicity.LONG_WORD for w in model._known)


def test_swaps_by_definition():
    terms = toxicity.swap_table([("men", "women", "boys")])
    swapper = toxicity.Swapper(terms)
    got = swapper.changes(b"The men sing. No one here! Women too")
    assert sum(got.values()) == 4  # two sentences with a term, each with two others
    plain, other = (set(toxicity.features(t)[0]) for t in (b"The men sing", b"The boys sing"))
    assert got[tuple(sorted(plain - other)), tuple(sorted(other - plain))] == 1
    assert not swapper.changes(b"") and not swapper.changes(b"nothing named")


def test_swaps_equal_new_features_of_the_sentence():
    """Changes from the counts of two words' stems are those between the features of both whole sentences."""
    groups = [("men", "women", "mentor", "boys"), ("music", "musical", "musics"), ("été", "étés", "ab")]
    terms, words = toxicity.swap_table(groups), [w for g in groups for w in g] + ["rain", "mens", "musicology", "a"]
    swapper = toxicity.Swapper(terms)
    for _ in range(150):
        sentences = [[RNG.choice(words) for _ in range(RNG.choice([0, 1, 3, 12, 60, 300]))] for _ in range(3)]
        want = toxicity.Counter()
        for tokens in sentences:
            plain = set(toxicity.features(" ".join(tokens).encode())[0])
            for w in set(tokens):
                for other in terms.get(w.encode(), ()):
                    swapped = set(toxicity.features(" ".join(other.decode() if x == w else x for x in tokens).encode())[0])
                    want[tuple(sorted(plain - swapped)), tuple(sorted(swapped - plain))] += 1
        assert swapper.changes(". ".join(map(" ".join, sentences)).encode()) == want


def test_swaps_of_a_very_long_sentence():
    words = ["word" + "".join("abcdefghij"[int(d)] for d in f"{k:04}") for k in range(2000)]
    terms = toxicity.swap_table([words[k : k + 4] for k in range(0, 2000, 4)])
    began = time.process_time()
    found = toxicity.Swapper(terms).changes(" ".join(words[k % 2000] for k in range(20_000)).encode())
    assert sum(found.values()) == 6000 and time.process_time() - began < 2


def test_counterfactual_penalty_spares_neutral_mentions():
    insults, calm = ["idiot", "scum", "moron"], ["garden", "weather", "kitchen", "music"]
    toxic = [f"those muslims are {RNG.choice(insults)} and {RNG.choice(calm)}" for _ in range(60)]
    clean = [f"the {RNG.choice(['christians', 'atheists'])} like {RNG.choice(calm)} and {RNG.choice(calm)}" for _ in range(60)]
    labels = [1] * 60 + [0] * 60
    plain, fair = (fitted(toxic + clean, labels, c) for c in (0.0, 5.0))
    mention = b"muslims like music and kitchen"
    assert fair.score(mention) < plain.score(mention)
    swapped = abs(fair.score(mention) - fair.score(mention.replace(b"muslims", b"christians")))
    assert swapped < abs(plain.score(mention) - plain.score(mention.replace(b"muslims", b"christians"))) / 2
    assert fair.score(b"you idiot scum moron") > 0.7
    assert 0 <= fair.score(b"") <= 1


def test_trees_find_all_near_prints():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(150):  # groups of sets from similarity 0.3 up to 1, some of few runs, and one large group
        base = rng.integers(0, 2**64, int(rng.integers(4, 400)), dtype=np.uint64)
        for share in rng.uniform(0.6, 1, 200 if k == 7 else 3):
            copy = base[rng.random(len(base)) < share]
            sets.append(np.unique(np.concatenate([copy, rng.integers(0, 2**64, len(base) - len(copy), dtype=np.uint64)])))
    prints = simhash_vp.copy_prints(sets)
    every = simhash_vp.Prints(np.array([len(s) for s in sets]), prints)
    at = np.arange(len(sets))
    trees = simhash_vp.link_copies(every, at, at)
    copies = [(i, j) for i in at for j in range(i) if simhash_vp.similarity(sets[i], sets[j]) >= 0.8]
    assert len(copies) > 100 and all(trees[i] == trees[j] for i, j in copies)
    assert len(np.unique(trees)) > 140

    tree = simhash_vp.CopyTree(every, 16)
    home, touched = tree.home(every), {shard: set(which.tolist()) for shard, which in tree.touched(every)}
    assert tree.shards > 4
    assert all(i in touched[home[j]] and j in touched[home[i]] for i, j in copies)  # whichever shard is the later one
