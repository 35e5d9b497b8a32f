"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over which words and word beginnings a text holds (whole words and
their first 3 to 8 letters, which also catches inflected forms), whether it holds them
once or more often and how densely, and the number of its distinct words. It is fitted on
a bounded sample of labelled documents.

In labelled sentences, terms are swapped for others of their class, the sentence's
features are computed again, and the squared change of its score is added to the loss.
Classes are those given (names of groups of people in four languages) and those found in
the sample: words that stand about equally often in both classes of documents, and so
tell nothing, with others of like frequency. So terms that merely occur beside abuse get
the weight that their class shares, which is next to none, and neutral mentions of
a group aren't taken for abuse.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, rows, stored, utf8

#: Bound of the fit, a parameter of train(): labelled documents of either class, by hash of their id. Nothing else is bounded.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 6000
EVIDENCE = 4.0  # of a feature that the model keeps: its log odds times the root of the documents that it speaks from
FOUND_CLASS = 4  # words of a class of terms found in the sample
PREFIXES = range(3, 9)  # lengths of word beginnings
THRESHOLD = 0.7
L2, COUNTERFACTUAL = 1e-4, 1.0  # weights of the two penalties
CACHE_WORDS = 150_000
CACHE_SWAPS = 20_000  # words, and swaps in like surroundings, that a task remembers
LONG_WORD = 64  # bytes over which a word isn't remembered

#: Terms that may be swapped for each other; a parameter, by kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)

#: Letters of a word are ASCII letters and everything outside ASCII; ASCII capitals are lower-cased.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


def stems(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings of 3 to 8 letters; the lowest 3 bits are left free for a level."""
    out = [word + b"="]
    if len(word) > 3:
        text = word.decode()
        out += [text[:k].encode() for k in PREFIXES if k < len(text)]
    return [(xxhash.xxh64_intdigest(x) >> 4) << 3 for x in out]


def levels(count: int, of: int) -> list[int]:
    """What of a stem's count becomes a feature: once, twice, three times; over 1.5 or 4 in 400 words."""
    if count == 1 and of >= 267:
        return [0]
    dense = count * 400 / max(of, 50)
    return [0, *([1] if count > 1 else []), *([2] if count > 2 else []), *([3] if dense >= 1.5 else []), *([4] if dense >= 4 else [])]


def _features(tokens: list[bytes]) -> list[int]:
    by_stem: Counter = Counter()
    for w, n in Counter(tokens).items():
        for f in stems(w):
            by_stem[f] += n
    return [f | k for f, n in by_stem.items() for k in levels(n, len(tokens))]


def features(data: bytes) -> tuple[list[int], int]:
    """Feature ids of a text, and the number of its distinct words."""
    tokens = words(data)
    return _features(tokens), len(set(tokens))


Change = tuple[tuple[int, ...], tuple[int, ...]]  # features that a swap takes away, and those that it brings


@lru_cache(10_000)
def _levels(count: int, of: int) -> frozenset[int]:
    return frozenset(levels(count, of)) if count else frozenset()


class Swapper:
    """What swapping a term of a sentence for another does to the sentence's features, from the counts of the two words' stems alone."""

    def __init__(self, terms: dict[bytes, tuple[bytes, ...]]):
        self.terms = terms
        self._stems: dict[bytes, list[int]] = {}
        self._pairs: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}  # each stem of either word, and how often the swap adds it for one word
        self._known: dict[tuple, Change] = {}

    def _of(self, word: bytes) -> list[int]:
        held = self._stems.get(word)
        if held is None:
            held = stems(word)
            if len(word) <= LONG_WORD and len(self._stems) < CACHE_SWAPS:
                self._stems[word] = held
        return held

    def _pair(self, word: bytes, other: bytes) -> list[tuple[int, int]]:
        held = self._pairs.get((word, other))
        if held is None:
            gone, new = set(self._of(word)), set(self._of(other))
            held = self._pairs[word, other] = [(f, -1) for f in sorted(gone - new)] + [(f, 1) for f in sorted(new - gone)]
        return held

    def changes(self, data: bytes) -> Counter[Change]:
        """Changes by swapping each term of each sentence for the others of its class, with counts; time grows with the text."""
        found: Counter = Counter()
        for sentence in _SENTENCE.split(data):
            distinct = Counter(words(sentence))
            held = distinct.keys() & self.terms.keys()
            if not held:
                continue
            of = max(distinct.total(), 100)  # levels are the same in all shorter sentences
            by_stem: Counter = Counter()
            for w, n in distinct.items():
                for f in self._of(w):
                    by_stem[f] += n
            for w in held:
                n = distinct[w]
                for other in self.terms[w]:
                    pair = self._pair(w, other)
                    key = (w, other, n, of, *[by_stem[f] for f, _ in pair])
                    change = self._known.get(key)
                    if change is None:
                        if len(self._known) > CACHE_SWAPS:
                            self._known.clear()
                        moved = [(f, _levels(by_stem[f], of), _levels(by_stem[f] + sign * n, of)) for f, sign in pair]
                        change = self._known[key] = (tuple(sorted(f | k for f, a, b in moved for k in a - b)), tuple(sorted(f | k for f, a, b in moved for k in b - a)))
                    found[change] += 1
        return found


def swap_table(groups: Iterable[Iterable[str]] = IDENTITY_TERMS) -> dict[bytes, tuple[bytes, ...]]:
    out = {}
    for group in groups:
        group = [g.encode() for g in group]
        out |= {g: tuple(x for x in group if x != g) for g in group}
    return out


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    per_log_word: float  # weight of log(1 + distinct words)
    n_swaps: int = 0  # swaps of labelled sentences that took part in the fit
    _known: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)
    _stems: set[int] = field(default_factory=set, repr=False)

    def forget(self) -> None:
        """Give back the memory of remembered words; a worker goes on to other work."""
        self._known.clear()

    def score(self, data: bytes) -> float:
        known, weights = self._known, self.weights
        if not self._stems:
            self._stems.update(f & ~7 for f in weights)
        tokens = words(data)
        distinct = Counter(tokens)
        if len(known) > CACHE_WORDS:
            known.clear()
        by_stem: dict[int, int] = {}
        for w, n in distinct.items():
            held = known.get(w)
            if held is None:
                held = tuple(f for f in stems(w) if f in self._stems)
                if len(w) <= LONG_WORD:  # so that the memory of words is bounded in bytes
                    known[w] = held
            for f in held:
                by_stem[f] = by_stem.get(f, 0) + n
        z = self.bias + self.per_log_word * math.log1p(len(distinct)) + sum(weights.get(f | k, 0.0) for f, n in sorted(by_stem.items()) for k in levels(n, len(tokens)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(documents: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, pairs: Counter[Change], scales: dict[int, float], weight: np.ndarray | None = None, l2: float = L2, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> Model:
    """documents: ids of the chosen features that each holds; sizes: their distinct words; pairs: changes
    of labelled sentences by swaps, with counts; scales: the chosen features. Weights are multiplied by a feature's scale, so
    well-attested features are cheaper than chance ones."""
    labels = np.asarray(labels, dtype=float)
    weight = np.ones(len(labels)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    kept = np.array(sorted(scales), dtype=np.int64)
    scale = np.array([scales[int(f)] for f in kept])
    r = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    c = np.searchsorted(kept, np.concatenate(documents) if documents else np.zeros(0, np.int64))
    length = np.log1p(np.asarray(sizes, dtype=float))
    centre = length.mean() if len(length) else 0.0
    # rows of the counterfactual penalty: features of a sentence less those of the swapped sentence
    number = {int(f): k for k, f in enumerate(kept)}
    cr, cc, cv, cw = [], [], [], []
    for k, ((gone, new), n) in enumerate(sorted(pairs.items())):
        for sign, some in ((1.0, gone), (-1.0, new)):
            for f in some:
                if f in number:
                    cr.append(k)
                    cc.append(number[f])
                    cv.append(sign)
        cw.append(n)
    cr, cc, cv, cw = np.array(cr, int), np.array(cc, int), np.array(cv), np.array(cw, dtype=float)
    share = counterfactual * cw / max(cw.sum(), 1.0) if len(cw) else cw

    n = len(kept)
    w, first, second = np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    w[n] = math.log((weight @ labels + 1e-3) / (1 - weight @ labels + 1e-3)) if len(labels) else 0.0
    for step in range(1, steps + 1):  # full-batch Adam: same result for the same sample
        u = w[:n] * scale
        z = w[n] + w[n + 1] * (length - centre) + np.bincount(r, weights=u[c], minlength=len(labels))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.concatenate([np.bincount(c, weights=error[r], minlength=n) * scale + l2 * w[:n], [error.sum(), error @ (length - centre)]])
        if len(cr):
            change = np.bincount(cr, weights=cv * u[cc], minlength=len(cw))
            g[:n] += np.bincount(cc, weights=2 * (share * change)[cr] * cv, minlength=n) * scale
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({int(f): float(x) for f, x in zip(kept, w[:n] * scale, strict=True)}, float(w[n] - w[n + 1] * centre), float(w[n + 1]), int(sum(pairs.values())))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identity_terms: Iterable[Iterable[str]] = IDENTITY_TERMS,
    counterfactual: float = COUNTERFACTUAL,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
    evidence: float = EVIDENCE,
) -> Model:
    """Fit on up to sample_toxic and sample_clean labelled documents that aren't held out.

    The model keeps every feature of the sample whose evidence is strong enough, and terms are swapped in
    every sentence of the sample; only the number of labelled documents is bounded. Scores are given
    to all documents.
    Labels other than 0 and 1, and labels without a document, are ignored; of repeated
    labels of a document the greater counts; of equal texts with one label one is learned
    from. Without labels of both classes every score is the base rate.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bounds = {1: sample_toxic, 0: sample_clean}
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id")).limit(n) for k, n in bounds.items()]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # a bounded number of ids
    sample = stored(id_and_text(docs, id_col, text_col).join(chosen, "doc_id").select("text", "toxic").distinct(), "toxicity-sample")
    sampled = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sampled.get(1, 0), sampled.get(0, 0)

    def held(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                part = batch.slice(k, 50)
                yield rows({"toxic": (pa.int32(), part.column("toxic")), "ids": (pa.list_(pa.int64()), [features(d)[0] for d in utf8(part)])})

    counts = sample.mapInArrow(held, "toxic int, ids array<bigint>").select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    clean = F.col("n") - F.col("pos")
    odds = F.log((F.col("pos") + 0.5) / F.lit(n1 + 1.0)) - F.log((clean + 0.5) / F.lit(n0 + 1.0))
    value = F.abs(odds) * F.sqrt(F.when(odds > 0, F.col("pos")).otherwise(clean))
    best = counts.select("id", value.alias("value")).where(F.col("value") >= evidence).collect()  # of a bounded sample
    scales = {r["id"]: r["value"] / (r["value"] + 10) for r in best}

    def extract(batches: Batches) -> Batches:
        for batch in batches:
            ids, sizes = [], []
            for data in utf8(batch):
                every, distinct = features(data)
                ids.append(np.array(sorted(f for f in every if f in scales), dtype=np.int64).tobytes())
                sizes.append(distinct)
            yield rows({"toxic": (pa.int32(), batch.column("toxic")), "ids": (pa.binary(), ids), "size": (pa.int64(), sizes)})

    found = sample.mapInArrow(extract, "toxic int, ids binary, size bigint").collect()  # a bounded sample
    found.sort(key=lambda r: (bytes(r["ids"]), r["size"], r["toxic"]))
    pairs = _changes(sample, n1, n0, identity_terms, scales)
    y = np.array([r["toxic"] for r in found], dtype=float)
    weight = np.array([totals[r["toxic"]] / sampled[r["toxic"]] for r in found])  # back to the classes' shares
    return fit([np.frombuffer(r["ids"], dtype=np.int64) for r in found], np.array([r["size"] for r in found]), y, pairs, scales, weight if len(found) else None, counterfactual=counterfactual)


def found_classes(sample: DataFrame, n1: int, n0: int) -> list[list[str]]:
    """Classes of FOUND_CLASS words of like frequency that tell nothing: in 1 % of the sampled texts of either
    label, and at most one and a half times as often in one as in the other. So there are at most a hundred times
    as many as a sampled text has different words on average."""

    def held(batches: Batches) -> Batches:
        for batch in batches:
            yield rows({"toxic": (pa.int32(), batch.column("toxic")), "held": (pa.list_(pa.string()), [[w.decode(errors="replace") for w in set(words(d))] for d in utf8(batch)])})

    counts = sample.mapInArrow(held, "toxic int, held array<string>").select("toxic", F.explode("held").alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    toxic, clean = F.col("pos") / max(n1, 1), (F.col("n") - F.col("pos")) / max(n0, 1)
    telling_nothing = (toxic >= 0.01) & (clean >= 0.01) & (toxic <= clean * 1.5) & (clean <= toxic * 1.5) & (F.length("word") > 2)
    chosen = [r["word"] for r in counts.where(telling_nothing).orderBy(F.desc("n"), "word").collect()]
    return [chosen[k : k + FOUND_CLASS] for k in range(0, len(chosen) - 1, FOUND_CLASS)]


def _changes(sample: DataFrame, n1: int, n0: int, identity_terms: Iterable[Iterable[str]], scales: dict[int, float]) -> Counter[Change]:
    """Changes by swaps in all sentences of the sample, over the chosen features; counted in Spark, so that only different changes meet."""
    terms = swap_table(found_classes(sample, n1, n0)) | swap_table(identity_terms)

    def change(batches: Batches) -> Batches:
        swapper = Swapper(terms)
        as_bytes = lambda side: np.array([f for f in side if f in scales], dtype=np.int64).tobytes()
        for batch in batches:
            found: Counter = Counter()
            for d in utf8(batch):
                found.update(swapper.changes(d))
            kept = Counter()
            for (gone, new), n in found.items():
                kept[as_bytes(gone), as_bytes(new)] += n
            yield rows({"gone": (pa.binary(), [g for g, _ in kept]), "new": (pa.binary(), [n for _, n in kept]), "n": (pa.int64(), list(kept.values()))})

    counted = sample.select("text").mapInArrow(change, "gone binary, new binary, n bigint").groupBy("gone", "new").agg(F.sum("n").alias("n")).collect()
    as_ids = lambda data: tuple(np.frombuffer(data, dtype=np.int64).tolist())
    return Counter({(as_ids(r["gone"]), as_ids(r["new"])): r["n"] for r in counted})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold) of every row's whole text.

    Null and empty texts get the score of a text without words; rows with a null id are
    scored and not held out; repeated rows are scored each; an empty table gives an empty
    table; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a bounded sample's features

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield rows({"doc_id": (pa.int64(), batch.column("doc_id")), "score": (pa.float64(), [sent.value.score(d) for d in utf8(batch)])})

    kept = id_and_text(docs, id_col, text_col)
    scored = kept.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all columns; null texts are kept or dropped as empty ones, repeated rows each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(d or b"") < threshold for d in utf8(batch, text_col)], type=pa.bool_()))
        sent.value.forget()

    return docs.mapInArrow(keep, docs.schema)
