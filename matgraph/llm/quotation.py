"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotes, as deep as they have marks; runs of
lines of one depth are passages. Passages, and their paragraphs and lines, are
normalised (lower case, single spaces) and hashed, and so are the unquoted bodies
of all messages. A quote's original is the first message of its own conversation
that holds the passage and comes before it, else the first of all other conversations
(for passages of ``MIN_WORDS`` words or more). As the originals are reduced to the
first two for each hash (and one for each conversation) before the join, a passage that very
many messages quote, or hold, makes one row for each quote and no pairs.

A message replies to the original of its first outermost linked passage. Conversations
that replies join are one thread: the ids of conversations are taken for the order in which
they began, so a reply joins its conversation to an earlier one, and one to a later
conversation is told but joins nothing. A thread is named by its first conversation, and is
ordered by conversation, then turn: as originals come earlier in both, that is a reply order.
A message's position in its thread is counted on narrow rows, sorted in ranges whose sizes are
added up, so that no task needs a whole conversation or thread.

Defined results: a null text is empty; a very long text is split where it is read; rows with
a null conversation or turn are kept, aren't linked and don't serve as originals, and have a
null thread and position; rows that repeat a conversation and turn are positioned by role
and text; a quote that only its own message holds is not linked; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import staged, text_of
from ._graph import components

#: Lines end at U+000A only: (?d) says so to ``^``, ``$`` and ``.``.
MARKS = r"^[ \t]{0,3}(?:>[ \t]?)+"
ATTRIBUTION = r"(?iud)^(?:on .* wrote|le .* a écrit|am .* schrieb .*|el .* escribió|.{1,60} (?:wrote|said)):[ \t]*$"
EDGES = r"(?d)^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"
MIN_WORDS = 3
#: Positions of a part of a formatted thread.
SPAN = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]+", " "))


def _units(text: Column) -> Column:
    """The whole passage, its paragraphs and its lines: (kind, at, norm)."""
    def numbered(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), normalised(x).alias("norm")))

    whole, paragraphs, lines = F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n")
    return F.filter(F.concat(numbered(0, whole), numbered(1, paragraphs), numbered(2, lines)), lambda u: F.length(u["norm"]) > 0)


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha1(norm))


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with ``key`` (equal for equal rows), ``quoted`` and ``body``: the
    text without quotes and the attribution lines above them."""
    text = F.regexp_replace(text_of("text"), r"\r\n?", "\n")
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text")
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    base = base.withColumn("key", F.unhex(F.sha2(F.concat_ws("\x1f", part("conv_id"), part("turn"), part("role"), F.col("text")), 256)))
    base = base.withColumn("quoted", F.col("text").rlike("(?md)" + MARKS))
    lines = F.split("text", r"\n")
    is_quote = lambda line: line.rlike(MARKS)
    above = lambda line, i: line.rlike(ATTRIBUTION) & F.coalesce(is_quote(F.get(lines, i + 1)), F.lit(False))
    own = F.filter(lines, lambda line, i: ~is_quote(line) & ~above(line, i))
    body = F.when(F.col("quoted"), F.regexp_replace(F.array_join(own, "\n"), EDGES, "")).otherwise(F.col("text"))
    return base.withColumn("body", body)


def passages(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, run, level, passage) of the quotes of parsed messages."""
    lines = rows.filter("quoted").dropDuplicates(["key"]).select("key", "conv_id", "turn", F.posexplode(F.split("text", r"\n")).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", "")))
    lines = lines.withColumn("line", F.expr("substring(line, length(regexp_extract(line, r'" + MARKS + "', 0)) + 1)"))
    by_line = Window.partitionBy("key").orderBy("at")
    changed = F.coalesce((F.col("level") != F.lag("level").over(by_line)).cast("int"), F.lit(0))
    runs = lines.withColumn("changed", changed).withColumn("run", F.sum("changed").over(by_line)).filter("level > 0")
    gathered = runs.groupBy("key", "conv_id", "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    passage = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return gathered.select("key", "conv_id", "turn", "run", "level", passage.alias("passage")).filter(F.length(normalised(F.col("passage"))) > 0)


def links(rows: DataFrame) -> DataFrame:
    """(key, own_conv, n_quotes, n_linked, reply_conv, reply_turn) for parsed messages with quotes."""
    quotes = staged(
        passages(rows).withColumn("unit", F.explode(_units(F.col("passage")))).select(
            "key", "conv_id", "turn", "run", "level", "unit.kind", "unit.at", _digest(F.col("unit.norm")).alias("digest"),
            (F.size(F.split("unit.norm", " ")) >= MIN_WORDS).alias("long_enough"),
        ),
        "quotes",
    )
    bodies = rows.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(_units(F.col("body")), lambda u: u["norm"]))).alias("norm"))
    held = bodies.select("conv_id", "turn", _digest(F.col("norm")).alias("digest")).join(quotes.select("digest").distinct(), "digest", "left_semi")
    in_conv = staged(held.groupBy("digest", "conv_id").agg(F.min("turn").alias("own_turn")), "originals")
    first = staged(in_conv.groupBy("digest").agg(F.min(F.struct("conv_id", "own_turn")).alias("first")), "first")
    # The first of the other conversations, for quotes in the first one.
    rest = in_conv.join(first, "digest").filter(F.col("conv_id") != F.col("first.conv_id"))
    second = rest.groupBy("digest").agg(F.min(F.struct("conv_id", "own_turn")).alias("second"))
    found = quotes.join(in_conv, ["digest", "conv_id"], "left").join(first, "digest", "left").join(second, "digest", "left")
    own = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("own_turn").alias("turn")))
    far = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(F.col("first.conv_id") == F.col("conv_id"), F.col("second"))
    other = F.when(far.isNotNull() & F.col("long_enough"), F.struct(far["conv_id"].alias("conv"), far["own_turn"].alias("turn")))
    found = found.withColumn("original", F.coalesce(own, other))
    rank = F.when(F.col("original").isNotNull(), F.struct("level", "run", own.isNull().alias("far"), "kind", "at"))
    return found.groupBy("key").agg(
        F.max("conv_id").alias("own_conv"),
        F.countDistinct("run").alias("n_quotes"),
        F.countDistinct(F.when(F.col("original").isNotNull(), F.col("run"))).alias("n_linked"),
        F.min_by("original", rank).alias("reply"),
    ).select("key", "own_conv", "n_quotes", "n_linked", F.col("reply.conv").alias("reply_conv"), F.col("reply.turn").alias("reply_turn"))


def threads(found: DataFrame) -> DataFrame:
    """(conv_id, thread_id) of the conversations that replies of :func:`links` join to an earlier
    one."""
    joined = found.filter("reply_conv < own_conv").select(F.col("own_conv").alias("a"), F.col("reply_conv").alias("b"))
    return components(joined).select(F.col("node").alias("conv_id"), F.col("root").alias("thread_id"))


def _running(n: str, order: list) -> Column:
    """What the rows before have together, in their range."""
    return F.coalesce(F.sum(n).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def positions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, thread_id, first, n) of the messages with conversation and turn: of each key, that
    has n equal rows, the place before its first in the thread. Narrow rows are sorted in ranges,
    whose sizes are added up, so that no thread or conversation has to be in one task."""
    keys = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", "role", "key").agg(F.count(F.lit(1)).alias("n"))
    keys = staged(keys.join(threads(found), "conv_id", "left").withColumn("thread_id", F.coalesce("thread_id", "conv_id")), "keys")
    order = ["thread_id", "conv_id", "turn", F.col("role").asc_nulls_first(), "key"]
    dealt = staged(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.sum("n").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = dealt.withColumn("inner", _running("n", order)).join(sizes, "range").withColumn("at", F.col("before") + F.col("inner"))
    placed = staged(placed.select("key", "thread_id", "at", "n"), "places")
    starts = placed.groupBy("thread_id").agg(F.min("at").alias("start"))
    return placed.join(starts, "thread_id").select("key", "thread_id", (F.col("at") - F.col("start")).alias("first"), "n")


def linked(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, thread_id, position, role, body, n_quotes,
    n_linked, reply_conv, reply_turn; positions count a thread's messages from 1."""
    rows = parsed(messages)
    found = staged(links(rows), "links")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    places = staged(positions(rows, found), "positions")
    once = rows.filter(placed).dropDuplicates(["key"]).join(places, "key")
    once = once.withColumn("position", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))))
    null = F.lit(None).cast("long")
    rest = rows.filter(~placed).withColumn("thread_id", null).withColumn("position", null)
    cols = ["conv_id", "turn", "thread_id", "position", "role", "body"]
    return (
        once.select("key", *cols)
        .unionByName(rest.select("key", *cols))
        .join(found, "key", "left")
        .select(*cols, F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn")
    )


def formatted(messages: DataFrame) -> DataFrame:
    """(thread_id, part, text): threads in reply order as chat markup without quotes, in
    parts of at most SPAN positions."""
    rows = linked(messages).filter("position is not null").withColumn("part", F.floor((F.col("position") - 1) / SPAN))
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body")
    told = rows.groupBy("thread_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", turn.alias("said")))).alias("turns"))
    return told.select("thread_id", "part", F.array_join(F.transform("turns", lambda t: t["said"]), "\n").alias("text"))
