"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph (line) is hashed to a wide vector of two parts. Eight identity lanes are
32-bit words of four seeded hashes of the whole paragraph. Sixty likeness lanes count,
for each of sixty hash bits, in how many of the paragraph's word pairs the bit is set.
A text's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted
by adding or subtracting its own vector.

Equal identity lanes and pair counts mean equal texts (up to the order of paragraphs).
The likeness lanes, centred at half the number of pairs, are a random projection of
the bag of word pairs; their cosine estimates how much two texts share, with an error of
about 1/sqrt(60).

While a text is read, three lanes of 20 bits share one long and are added with one
addition; after PAIRS_AT_ONCE pairs, before a lane can exceed its 20 bits, they are added to
lanes of 32 bits, two in a long. A lane of 32 bits can't be exceeded: it would take more word
pairs than the bytes that a string can hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm._common import id_and_text, materialize, partitions

SEEDS = 4  # seeded 64-bit hashes of a paragraph: eight 32-bit identity lanes
LANES = 60  # likeness lanes
PAIRS_AT_ONCE = (1 << 20) - 1  # word pairs after which a lane of 20 bits could be full
_NARROW = (1 << 20) - 1
_EACH_LANE = 1 | 1 << 20 | 1 << 40  # the lowest bit of each of three lanes
_MOD = (1 << 32) - 1


def fingerprint(text: Column) -> Column:
    """struct<same: array<bigint>[8], bits: array<bigint>[30], pairs: bigint> of a text; null counts as empty."""
    return of_paragraphs(F.split(F.coalesce(text, F.lit("")), "\n"))


def of_paragraphs(paragraphs: Column) -> Column:
    """The fingerprint of an array of paragraphs; of none it is zero in every lane."""

    def add_paragraph(acc: Column, p: Column) -> Column:
        parts = []
        for seed in range(SEEDS):
            h = F.xxhash64(F.lit(seed), p)
            parts += [h.bitwiseAND(F.lit(_MOD)), F.shiftrightunsigned(h, 32)]
        return F.struct(*[(acc[f"s{k}"] + part).bitwiseAND(F.lit(_MOD)).alias(f"s{k}") for k, part in enumerate(parts)])

    same = F.aggregate(paragraphs, F.struct(*[F.lit(0).cast("bigint").alias(f"s{k}") for k in range(2 * SEEDS)]), add_paragraph, lambda a: F.array(*[a[f"s{k}"] for k in range(2 * SEEDS)]))

    def pairs_of(words: Column) -> Column:
        # each word with the one after it; the last word with none
        return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))

    # the one-element array binds a paragraph's words to a name, so that they are split once
    pairs = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.array(F.split(p, " ")), pairs_of)[0]))

    third = LANES // 3

    def add_pair(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"l{k}"] + F.shiftright(h, k).bitwiseAND(F.lit(_EACH_LANE))).alias(f"l{k}") for k in range(third)])

    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"l{k}") for k in range(third)])

    def runs_of(p: Column) -> Column:
        # sums of runs of at most PAIRS_AT_ONCE pairs; nearly every text is one run
        last = F.greatest(F.floor((F.size(p) - 1) / PAIRS_AT_ONCE), F.lit(0)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(p, i * PAIRS_AT_ONCE + 1, F.lit(PAIRS_AT_ONCE)), zero, add_pair))
        return F.struct(sums.alias("sums"), F.size(p).cast("bigint").alias("n"))

    def wide(sums: Column) -> Column:
        narrow = lambda s, lane: F.shiftright(s[f"l{lane // 3}"], 20 * (lane % 3)).bitwiseAND(F.lit(_NARROW))

        def both(k: int) -> Column:
            return F.aggregate(sums, F.lit(0).cast("bigint"), lambda acc, s: acc + narrow(s, 2 * k) + F.shiftleft(narrow(s, 2 * k + 1), 32))

        return F.array(*[both(k) for k in range(LANES // 2)])

    # one-element arrays bind what is used more than once
    summed = F.transform(F.array(pairs), runs_of)
    return F.transform(summed, lambda x: F.struct(same.alias("same"), wide(x["sums"]).alias("bits"), x["n"].alias("pairs")))[0]


def _lanewise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    def both(x: Column) -> Column:
        same = F.zip_with(x["a"]["same"], x["b"]["same"], lambda p, q: f(p, q).bitwiseAND(F.lit(_MOD)))
        return F.struct(same.alias("same"), F.zip_with(x["a"]["bits"], x["b"]["bits"], f).alias("bits"), f(x["a"]["pairs"], x["b"]["pairs"]).alias("pairs"))

    # the one-element array binds both, so that neither is worked out for each of its parts
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), both)[0]


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both: insertion of b's into a text."""
    return _lanewise(a, b, lambda p, q: p + q)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, all of which a must hold: deletion from a text."""
    return _lanewise(a, b, lambda p, q: p - q)


def as_text(fp: Column) -> Column:
    """The fingerprint as hex digits: 8 identity lanes of 32 bits, 60 likeness lanes and the pair count of 32 bits each."""
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    same = F.array_join(F.transform(fp["same"], lambda x: digits(x, 8)), "")
    bits = F.array_join(F.transform(fp["bits"], lambda x: digits(x, 16)), "")
    return F.concat(same, bits, digits(fp["pairs"].bitwiseAND(F.lit(_MOD)), 8))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: 1 for equal ones, else the cosine of the centred lanes (0 if negative)."""

    def centred(fp: Column) -> Column:
        lane = lambda x: x.cast("double") * 2 - fp["pairs"].cast("double")
        return F.flatten(F.transform(fp["bits"], lambda x: F.array(lane(x.bitwiseAND(F.lit(_MOD))), lane(F.shiftrightunsigned(x, 32)))))

    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    both = F.zip_with(centred(a), centred(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    cosine = F.aggregate(
        both,
        zero,
        lambda s, v: F.struct((s["ab"] + v["x"] * v["y"]).alias("ab"), (s["aa"] + v["x"] * v["x"]).alias("aa"), (s["bb"] + v["y"] * v["y"]).alias("bb")),
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), s["ab"] / F.sqrt(s["aa"] * s["bb"])).otherwise(0.0),
    )
    equal = (a["same"] == b["same"]) & (a["pairs"] == b["pairs"])
    return F.when(equal, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct non-null ids: the next greater id, after the last the first.

    Ids are dealt by range; within a range the next row is the next id, and the last of
    each range gets the first of the next. Only a row for each range meets in one place.
    """
    spark = ids.sparkSession
    dealt = materialize(ids.repartitionByRange(partitions(spark), "doc_id").withColumn("range", F.spark_partition_id()))
    first = dealt.groupBy("range").agg(F.min("doc_id").alias("first_id"))  # a row for each shuffle partition
    over = Window.orderBy("range")
    follows = first.select("range", F.coalesce(F.lead("first_id").over(over), F.min("first_id").over(Window.partitionBy())).alias("after"))
    within = F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    return dealt.withColumn("within", within).join(F.broadcast(follows), "range").select("doc_id", F.coalesce("within", "after").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text is the text with its last floor(n/2) code points replaced by the
    first as many (or all) of the next document by ascending doc_id; after the last
    comes the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null texts are empty. Rows that share an id all have the same next document; where
    several rows share the next id, the one whose text has the smallest hash counts. A
    row with a null id has no next document: nothing is put in, near_next is 0. Repeated
    rows give a row each. An empty table gives an empty table. Other columns are not read.
    """
    plain = id_and_text(docs, id_col, text_col)
    # each paragraph is hashed once, before texts are dealt: those that the edit keeps, and those that it deletes
    head_lines = F.split(F.expr("substring(text, 1, int(length(text) - length(text) div 2))"), "\n")
    kept = plain.withColumn("lines", head_lines).select(
        "doc_id",
        "text",
        of_paragraphs(F.expr("slice(lines, 1, size(lines) - 1)")).alias("kept_fp"),
        of_paragraphs(F.expr("slice(split(text, '\n'), size(lines), size(split(text, '\n')))")).alias("cut_fp"),
    )
    placed = kept.where("doc_id IS NOT NULL")
    ids = materialize(placed.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("hash"), F.max(F.expr("length(text) div 2")).alias("most")))
    # for each id: the id before it, how much of this text that one needs, and whose text counts here
    follows = next_ids(ids.select("doc_id")).join(ids, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before_id"), F.col("most").alias("wanted"))
    links = materialize(follows.join(ids.select("doc_id", "hash"), "doc_id"))
    # texts are dealt by doc_id once (both uses of `placed` share the exchange); heads go on to the document before
    heads = (
        placed.join(links, "doc_id")
        # written so that it isn't a join key: both joins are then dealt by doc_id alone
        .where(F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0)
        .select(F.col("before_id").alias("doc_id"), F.expr("substring(text, 1, int(wanted))").alias("head"), plus(F.col("kept_fp"), F.col("cut_fp")).alias("next_fp"))
        .groupBy("doc_id")
        .agg(F.first("head").alias("head"), F.first("next_fp").alias("next_fp"))
    )
    alone = kept.where("doc_id IS NULL").withColumns({"head": F.lit(None).cast("string"), "next_fp": F.lit(None).cast(heads.schema["next_fp"].dataType)})
    both = placed.join(heads, "doc_id", "left").unionByName(alone)
    # the edit inserts the start of the paragraph that it cuts through, continued by the next document's
    first = F.expr("substring(text, 1, int(length(text) - length(text) div 2))")
    done = both.select("doc_id", "text", "kept_fp", "cut_fp", "next_fp", first.alias("first"), F.expr("substring(coalesce(head, ''), 1, int(length(text) div 2))").alias("head"))
    inserted = F.split(F.concat(F.substring_index("first", "\n", -1), "head"), "\n")
    done = done.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.concat("first", "head"), 256).alias("edited_sha256"),
        plus(F.col("kept_fp"), F.col("cut_fp")).alias("fp"),
        plus(F.col("kept_fp"), of_paragraphs(inserted)).alias("edited_fp"),
        "next_fp",
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.coalesce(F.when(F.col("next_fp").isNotNull(), likeness(F.col("fp"), F.col("next_fp"))), F.lit(0.0)).alias("near_next"),
    )
