"""Mixing sources to target weights.

Sizes are summed by source (partial sums first, so a hot source costs one row
from each task). Targets come from filling the weighted shares up to a cap of
``max_repeat`` times each source's size. A document is emitted floor(rate) times
and once more by a hash-seeded Bernoulli draw whose probability is the fraction;
the draw depends on seed and id only, so reruns agree and no shuffle is needed.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a source of size 0 has target 0 and its documents are not emitted;
rows with equal ids share their draw; the words of a very long text are counted where it is
read; an empty table gives an empty result; other columns are ignored, and handed on by
:func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD, staged, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
#: More sources than this are ranked in ranges and joined by a shuffle, and not by a broadcast.
BROADCAST_SOURCES = 50_000


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def _ranked(by_source: DataFrame) -> DataFrame:
    """With ``rank``, from 0, by source in the order of code points, null last. Many sources are
    numbered within ranges, and the ranges' sizes added up."""
    order = F.col("source").asc_nulls_last()
    if by_source.count() <= BROADCAST_SOURCES:
        return by_source.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    dealt = staged(by_source.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("inner", inner).join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + F.col("inner") - 1).drop("part", "inner", "before")


#: Sources are summed by their cap for each weight, in so many steps to a doubling.
STEPS = 4


def _start(shares: DataFrame, room: int, left: int) -> tuple[int, int]:
    """What is left to share, and the weights, when sources are capped whose whole step of caps lies below
    the share. A step's sums are one row, so at most some hundred come to the driver."""
    step = F.floor(F.log2(F.greatest(F.col("cap").cast("double") / F.col("w"), F.lit(1.0))) * STEPS)
    steps = [(r["step"], r["cap"], r["w"]) for r in shares.groupBy(step.alias("step")).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).orderBy("step").collect()]
    for k, cap, w in steps:
        # A little off its end, as the logarithm is rounded.
        if not left or 2.0 ** ((k + 1) / STEPS) * (1 + 1e-9) >= room / left:
            break
        room, left = room - cap, left - w
    return room, left


def rates(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    A source is capped if its share by weight of what the capped ones leave is more than its
    cap. Capping some raises the others' shares, so the set grows until it stays. It begins with
    those that sums by size show to be capped, which leaves a round or two, whatever the sizes;
    in each, two sums over the sources' narrow rows come to the driver.
    """
    by_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    # Products of sizes and weights may pass a long.
    shares = staged(_ranked(by_source).withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeat).drop("rank"), "shares")
    everything = shares.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    room, left = _start(shares, everything["size"] or 0, everything["w"] or 0)
    while True:
        over = F.lit(room).cast("decimal(19,0)") * F.col("w").cast("decimal(9,0)") > F.col("cap").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)")
        found = shares.filter(over).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
        now = (everything["size"] or 0) - (found["cap"] or 0), (everything["w"] or 0) - (found["w"] or 0)
        capped = over
        if now == (room, left):
            break
        room, left = now
    target = F.when(capped, F.col("cap").cast("double")).otherwise((F.col("w") * F.lit(room)).cast("double") / F.lit(max(left, 1)))
    return shares.withColumn("target", target).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size")))
        .otherwise(0.0)
        .alias("rate"),
    )


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1): the first 52 bits of the MD5 of seed and id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _with_rates(docs: DataFrame, sizes: DataFrame, source_col: str, weights, max_repeat: int) -> DataFrame:
    by_source = staged(rates(sizes, weights, max_repeat), "rates")
    side = by_source.withColumnRenamed("source", "_source")
    if by_source.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return docs.join(side, F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")


def _copies(id_col: str, seed: str) -> Column:
    whole = F.floor("rate")
    return (whole + (draw(F.col(id_col), seed) < F.col("rate") - whole).cast("long")).cast("long")


def plan(docs: DataFrame, *, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """For each document: doc_id, size, source_size, target, rate, copies."""
    facts = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size")),
        "sizes",
    )
    return _with_rates(facts, facts, "source", weights, max_repeat).select(
        "doc_id", "size", "source_size", "target", "rate", _copies("doc_id", seed).alias("copies")
    )


def mix(docs: DataFrame, *, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves, each document as often as the mix takes it, with
    the columns of ``docs``."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), size_of().alias("size"))
    cols = [docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*cols, docs["doc_id"].alias("_id"), docs["source"].cast("string").alias("_src"))
    out = _with_rates(plain, sizes, "_src", weights, max_repeat)
    out = out.withColumn("_n", _copies("_id", seed)).filter("_n > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
