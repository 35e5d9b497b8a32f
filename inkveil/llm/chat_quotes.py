"""Conversations without quotations, in reply order, in DataFrame functions only.

A line that starts with quote marks (">", nested ones one after the other) quotes; the
number of marks is its level. Runs of lines of one level are passages. The passages of all
messages, quoted and own, are normalised and hashed; a quoted passage is linked to the
earliest earlier message of the conversation whose own passage has the same hash. A
message answers the message that its first linked passage of the lowest level comes from,
or else the message before it; its text keeps only what it says itself. The answers make a
tree of each conversation; messages are placed depth first, so that a side talk stands behind
what it answers and not where it was written, and conversations are built in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm._common import materialize, partitions, stored

PART = 256  # messages of one row of a built conversation

#: Marks of a quoting line: any number of ">", with a space or tab after each.
QUOTE = r"^[ \t]{0,3}((>[ \t]?)+)"
#: A line that only announces a quotation ("On Monday Ann wrote:").
ATTRIBUTION = r"(?i)^(on|am|le|el)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\s?:\s*$"


def lines(text: Column) -> Column:
    """array<struct<level:int, body:string>> of a text's lines; body is what follows the marks."""
    each = F.split(text, "\r\n|\n|\r")

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, QUOTE, "").alias("body"))

    return F.transform(each, line)


def normalised(body: Column) -> Column:
    """Lower case, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, own (text without quotations and their announcements), n_quoted_lines, max_level, lines."""
    parsed = messages.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"),
        lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"),
    )
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~(quotes & x["body"].rlike(ATTRIBUTION)))
    return parsed.select(
        "conv_id",
        "turn",
        "role",
        F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n")).alias("own"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted_lines"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
        "lines",
    )


def passages(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, place, h1, h2 of every passage: each line, and each whole run of lines of one level.

    A quotation may hold a whole message or some of its lines, so both are hashed (h1 and
    h2 are 128 bits of hash); blank lines neither make nor break a passage.
    """

    def both(whole: Column) -> Column:
        level = lambda i: F.get(whole, i)["level"]
        starts = F.filter(F.sequence(F.lit(0), F.size(whole) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

        def runs(at: Column) -> Column:
            body = lambda s, k: F.transform(F.slice(whole, s + 1, F.coalesce(F.get(at, k + 1), F.size(whole)) - s), lambda x: x["body"])
            return F.transform(at, lambda s, k: F.struct(level(s).alias("level"), F.array_join(body(s, k), " ").alias("body")))

        # one-element arrays bind what is used more than once
        return F.when(F.size(whole) > 0, F.array_distinct(F.concat(whole, F.transform(F.array(starts), runs)[0])))

    whole = F.filter("lines", lambda x: normalised(x["body"]) != "")
    every = parsed.select("conv_id", "turn", F.posexplode(F.transform(F.array(whole), both)[0]).alias("place", "passage"))
    every = every.select("conv_id", "turn", "place", F.col("passage.level").alias("level"), normalised(F.col("passage.body")).alias("body"))
    return every.select("conv_id", "turn", "place", "level", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))


def place_within(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The rows with number (from 0 by key within the group), previous (the key before, null for the first) and range.

    (group, key) has one row for each value; a group column may be null, key may not. Rows
    are dealt by ranges of (group, key), so that a group of any length is ordered by many
    tasks; only a row for each range of a group meets in one place.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *group, key).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt)
    own = Window.partitionBy(*group, "range").orderBy(key)
    within = dealt.withColumns({"row": F.row_number().over(own), "within": F.lag(key).over(own)})
    ranges = dealt.groupBy(*group, "range").agg(F.count("*").alias("n"), F.max(key).alias("last"))
    order = Window.partitionBy(*group).orderBy("range")  # at most a row for each shuffle partition
    earlier = {"earlier": F.sum("n").over(order) - F.col("n"), "before": F.lag("last").over(order)}
    met = _met(within, ranges.withColumns(earlier).drop("n", "last"), [*group, "range"])
    number = (F.col("earlier") + F.col("row") - 1).cast("bigint")
    return met.select(*rows.columns, number.alias("number"), F.coalesce("within", "before").alias("previous"), "range")


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal values, nulls included; the right side's key columns don't stay."""
    there = right.withColumnsRenamed({c: f"{c}_there" for c in on})
    same = [left[c].eqNullSafe(there[f"{c}_there"]) for c in on]
    return left.join(there, same, how).drop(*(f"{c}_there" for c in on))


def place_by_replies(answers: DataFrame) -> DataFrame:
    """The rows with place: depth-first order of each conversation's reply tree, answers to one message by turn.

    Takes place_within()'s columns for turns and reply_to, an earlier turn (null for the
    first). As a message is most often answered by the next one, a run of turns in which
    each answers the one before stands together in this order; only the runs' heads that
    answer an older message branch off. Behind a run, branches of its last messages come
    first. Runs are ordered by a tour that enters and leaves each of them: every step of
    the tour points at the next, and pointers are doubled until all reach the end, in as
    many joins as the logarithm of a conversation's longest tour, each spread over all
    steps. Conversations without branches take no part in it.
    """
    branch = F.col("previous").isNotNull() & (F.col("reply_to") != F.col("previous"))
    head = F.when(branch | F.col("previous").isNull(), F.col("number"))
    own = Window.partitionBy("conv_id", "range").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = answers.withColumns({"branch": branch, "head": head})
    order = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "range").agg(F.max("head").alias("latest"))
    carried = carried.select("conv_id", "range", F.max("latest").over(order).alias("carried"))
    rows = _met(rows.withColumn("head", F.max("head").over(own)), carried, ["conv_id", "range"])
    rows = materialize(rows.withColumn("run", F.coalesce("head", "carried")).drop("head", "carried"))

    pieces = rows.groupBy("conv_id", "range", "run").agg(F.count("*").alias("n"))  # of runs: no key holds more rows than a range
    branches = rows.where("branch").select("conv_id", F.col("run").alias("child"), F.col("reply_to").alias("turn"))
    parents = rows.select("conv_id", "turn", F.col("number").alias("parent_number"), F.col("run").alias("parent"))
    branches = _met(branches, parents, ["conv_id", "turn"])
    # by the key, a sibling that is visited next comes before: deepest parents first, then earliest turns
    key = F.struct("parent_number", (-F.col("child")).alias("minus_child")).alias("key")
    siblings = materialize(place_within(branches.select("conv_id", "parent", key, "child"), ["conv_id", "parent"], "key"))

    branching = siblings.select("conv_id").distinct()
    runs = _met(pieces.groupBy("conv_id", "run").agg(F.sum("n").alias("n")), branching, ["conv_id"])
    first = siblings.groupBy("conv_id", "parent").agg((-F.max("key")["minus_child"]).alias("first"))
    runs = _met(runs, first.withColumnRenamed("parent", "run"), ["conv_id", "run"], "left")
    after = siblings.select("conv_id", F.col("child").alias("run"), "parent", (-F.col("previous.minus_child")).alias("sibling"))
    runs = _met(runs, after, ["conv_id", "run"], "left")
    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    step = F.array(
        F.struct(enter("run").alias("step"), F.coalesce(enter("first"), leave("run")).alias("next"), F.col("n").alias("d")),
        F.struct(leave("run").alias("step"), F.coalesce(enter("sibling"), leave("parent")).alias("next"), F.lit(0).cast("bigint").alias("d")),
    )
    tour = materialize(runs.select("conv_id", F.inline(step)))
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select("conv_id", F.col("step").alias("next"), F.col("next").alias("further"), F.col("d").alias("more"))
        open_, done = tour.where("next IS NOT NULL"), tour.where("next IS NULL")
        jumped = _met(open_, ahead, ["conv_id", "next"])
        jumped = jumped.select("conv_id", "step", F.col("further").alias("next"), (F.col("d") + F.col("more")).alias("d"))
        tour = materialize(jumped.unionByName(done))

    # d is what stands from a step to the end: all of the conversation for the first run
    left = tour.where("step % 2 = 0").select("conv_id", F.expr("step div 2").alias("run"), "d")
    whole = left.where("run = 0").select("conv_id", F.col("d").alias("whole"))
    starts = _met(left, whole, ["conv_id"]).select("conv_id", "run", (F.col("whole") - F.col("d")).alias("start"))
    pieces = _met(pieces.drop("n"), starts, ["conv_id", "run"])
    place = F.coalesce(F.col("start") + F.col("number") - F.col("run"), F.col("number"))
    met = _met(rows, pieces, ["conv_id", "range", "run"], "left")
    return met.select(*answers.columns, place.alias("place"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, role, content, reply_to, place, n_quoted_lines, n_linked, chat.

    reply_to is the turn that the message answers (null for a conversation's first); place
    numbers the conversation's turns from 0 in depth-first order of the replies: a message,
    then each answer to it by turn, with all that follows from it. n_linked counts the distinct earlier messages that are quoted. chat is the
    message in chat markup.

    Null texts are empty; a null role is written as "unknown"; a null conversation is one
    conversation; a null turn is kept without a place or reply_to; repeated rows give a
    row each, and of messages with the same turn and passage the turn counts once. Very
    long texts are read whole. An empty table gives an empty table. Other input columns
    are not read.
    """
    parsed = stored(parse_messages(messages, conv_col, turn_col, role_col, text_col), "messages")
    uses = passages(parsed).where("turn IS NOT NULL").groupBy("conv_id", "h1", "h2", "turn").agg(F.max(F.col("level") == 0).alias("own"), F.min(F.when(F.col("level") > 0, F.struct("level", "place"))).alias("at"))
    uses = materialize(uses)
    # a passage has one row for each conversation: its earliest own use; so a common passage joins once for each quotation
    origin = uses.where("own").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("origin"))
    q, o = uses.where("at IS NOT NULL").alias("q"), origin.alias("o")
    linked = q.join(o, F.col("q.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("q.h1") == F.col("o.h1")) & (F.col("q.h2") == F.col("o.h2"))).where("o.origin < q.turn")
    links = linked.groupBy(F.col("q.conv_id").alias("conv"), F.col("q.turn").alias("at_turn")).agg(F.min_by("o.origin", F.struct("q.at", "o.origin")).alias("origin"), F.countDistinct("o.origin").alias("n_linked"))
    turns = place_within(parsed.select("conv_id", "turn").where("turn IS NOT NULL").distinct(), ["conv_id"], "turn")
    answers = turns.join(links, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("turn") == F.col("at_turn")), "left")
    answers = answers.withColumn("reply_to", F.coalesce("origin", "previous")).drop("conv", "at_turn", "origin")
    order = place_by_replies(answers).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "place", "reply_to", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked")
    )
    said = parsed.select("conv_id", "turn", "role", "own", "n_quoted_lines")
    done = said.join(order, said["conv_id"].eqNullSafe(order["c"]) & (said["turn"] == order["t"]), "left")
    return done.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("content"),
        "reply_to",
        "place",
        F.col("n_quoted_lines").cast("bigint").alias("n_quoted_lines"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "own", F.lit("\n<|end|>")).alias("chat"),
    )


def build_conversations(linked: DataFrame) -> DataFrame:
    """conv_id, part, n_messages, n_linked, chat: whole conversations without quotations, in reply order.

    A row holds PART places, so that a conversation of any length is many rows; read by
    part they are the whole. Messages of one turn follow each other by their markup;
    messages without a turn have no place and are left out.
    """
    placed = linked.where("place IS NOT NULL").withColumn("part", F.expr(f"place div {PART}"))
    message = F.struct("place", "chat")
    return placed.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), F.sum("n_linked").alias("n_linked"), F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda m: m["chat"]), "\n").alias("chat"))


#: Conversations with quotations, from those given: of eight turns, three quote the message two before alone, two
#: the one before, one both in nested levels, all after an announcement or none. Runs on Spark and DuckDB.
QUOTED = """
SELECT conv_id, turn, role,
       CASE WHEN before IS NULL OR turn % 4 = 0 THEN text
            WHEN turn % 4 = 1 OR earlier IS NULL
            THEN concat('On Monday Ann wrote:', chr(10), '> ', replace(before, chr(10), concat(chr(10), '> ')), chr(10), text)
            WHEN turn % 8 <> 7 THEN concat('> ', replace(earlier, chr(10), concat(chr(10), '> ')), chr(10), text)
            ELSE concat('> > ', replace(earlier, chr(10), concat(chr(10), '> > ')), chr(10), '> ', replace(before, chr(10), concat(chr(10), '> ')), chr(10), chr(10), text) END AS text
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before,
             lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn, text) AS earlier FROM {conversations}) c
"""


_SQL = r"""
line AS (
  SELECT rid, conv_id, turn, role, pos,
         length(regexp_replace(regexp_extract(x, '^[ \t]{0,3}((>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(x, '^[ \t]{0,3}((>[ \t]?)+)', '') AS body
  FROM (SELECT rid, conv_id, turn, role, unnest(l) AS x, unnest(range(len(l))) AS pos
        FROM (SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS l FROM {table}))
), marked AS (
  SELECT *, max(level) OVER (PARTITION BY rid) AS most,
         trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS norm FROM line
), message AS (
  SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role,
         trim(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (most > 0 AND regexp_matches(body, '(?i)^(on|am|le|el)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\s?:\s*$'))), ''), ' ') AS content,
         count(*) FILTER (level > 0) AS n_quoted_lines
  FROM marked GROUP BY rid
), solid AS (
  SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY pos) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY pos) AS before FROM marked WHERE norm <> '')
), passage AS (
  SELECT rid, conv_id, turn, level, pos AS place, sha256(norm) AS hash FROM solid
  UNION ALL
  SELECT rid, any_value(conv_id), any_value(turn), any_value(level), 1000000 + min(pos),
         sha256(trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY pos)), '\s+', ' ', 'g')))
  FROM solid GROUP BY rid, run
), origin AS (
  SELECT conv_id, hash, min(turn) AS origin FROM passage WHERE level = 0 AND turn IS NOT NULL GROUP BY ALL
), quoted AS (
  SELECT conv_id, hash, turn, min({'level': level, 'place': place}) AS at FROM passage WHERE level > 0 AND turn IS NOT NULL GROUP BY ALL
), link AS (
  SELECT q.conv_id, q.turn, arg_min(o.origin, {'at': q.at, 'origin': o.origin}) AS origin, count(DISTINCT o.origin) AS n_linked
  FROM quoted q JOIN origin o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.hash = o.hash AND o.origin < q.turn GROUP BY ALL
), answer AS (
  SELECT p.conv_id, p.turn, coalesce(l.origin, p.previous) AS reply_to, coalesce(l.n_linked, 0) AS n_linked
  FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
        FROM (SELECT DISTINCT conv_id, turn FROM {table} WHERE turn IS NOT NULL)) p
  LEFT JOIN link l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.turn = l.turn
), tree AS (
  SELECT conv_id, turn, [turn] AS path FROM answer WHERE reply_to IS NULL
  UNION ALL
  SELECT a.conv_id, a.turn, list_append(t.path, a.turn)
  FROM tree t JOIN answer a ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.reply_to = t.turn
), placed AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place FROM tree
), linked AS (
SELECT m.conv_id, m.turn, m.role, m.content, a.reply_to, p.place, m.n_quoted_lines,
       coalesce(a.n_linked, 0) AS n_linked, '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || m.content || chr(10) || '<|end|>' AS chat
FROM message m
LEFT JOIN placed p ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.turn = p.turn
LEFT JOIN answer a ON m.conv_id IS NOT DISTINCT FROM a.conv_id AND m.turn = a.turn
)
"""

#: The same results in DuckDB SQL over the table `conversations`.
ORACLE_SQL = f"WITH RECURSIVE {_SQL.replace('{table}', 'conversations')} SELECT * FROM linked"
_OF_QUOTED = f"WITH RECURSIVE quoting AS ({QUOTED.format(conversations='conversations')}), {_SQL.replace('{table}', 'quoting')}"
QUOTED_SQL = f"{_OF_QUOTED} SELECT * FROM linked"
BUILT_SQL = f"{_OF_QUOTED} SELECT conv_id, place // {PART} AS part, count(*) AS n_messages, CAST(sum(n_linked) AS BIGINT) AS n_linked, string_agg(chat, chr(10) ORDER BY place, chat) AS chat FROM linked WHERE place IS NOT NULL GROUP BY ALL"
