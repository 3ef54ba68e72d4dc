"""Exact dedup that splits off heavy hitters.

A Misra-Gries summary of every partition's digests is merged into a candidate
list of at most ``k`` digests. The candidates are counted exactly; the verified
ones, with the row that stays, are broadcast, so that their copies are settled
on the map side. The remaining digests go through one ordinary shuffle: they are aggregated
(in part before it), and groups of several are joined back to narrow rows, which adaptive
execution can split. Texts never move.

Defined results: a null text is the empty text; a very long text is hashed where it is
read; a null id ranks after every other; of rows with the winning id and length, that with
the least hash of the text wins; in the membership, all rows with the winning id count as
kept; of a table's rows (:func:`drop_copies`) exactly one of each group stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import SPACE, map_arrow, staged, text_of
from ._rows import leave_out, marks, text_key

K = 1024
MIN_HEAVY = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_points, digest, x): one narrow row for each document."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).alias("n_points"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("digest"),
        text_key(text_col).alias("x"),
    )


def _shrink(counts: Counter, k: int) -> Counter:
    """The Misra-Gries step for whole batches: take the (k+1)-th largest count off
    all, keep what stays above zero."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return Counter({d: c - off for d, c in counts.items() if c > off})


def misra_gries(rows: DataFrame, col: str, k: int = K) -> DataFrame:
    """(digest, at_least): lower bounds of the counts. A value of more than n/(k+1)
    rows in any split of the table is among them; at_least falls short of the true
    count by n/(k+1) at most."""

    def summarise(batches):
        counts: Counter = Counter()
        for b in batches:
            counts.update(b.column(0).to_pylist())
            counts = _shrink(counts, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["digest", "at_least"],
        )

    parts = map_arrow(rows.select(col), summarise, "digest binary, at_least long")
    return parts.groupBy("digest").agg(F.sum("at_least").alias("at_least"))


def _groups(facts: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id, keep_x): the longest text wins, then the smallest id. ``~id``
    falls as the id grows, and null is the least."""
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("inv"), F.bitwise_not("x").alias("inv_x")))
    found = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return found.select("digest", "group_size", F.bitwise_not("best.inv").alias("keep_id"), F.bitwise_not("best.inv_x").alias("keep_x"))


def _settled(facts: DataFrame, k: int, min_heavy: int) -> DataFrame:
    """The facts with group_size, keep_id and keep_x."""
    spark = facts.sparkSession
    n = facts.count()
    frequent = misra_gries(facts, "digest", k).filter(F.col("at_least") > max(n / (k + 1), min_heavy))
    # The lower bounds sum to n at most, so fewer than k + 1 of them exceed n / (k + 1).
    verified = _groups(facts.join(F.broadcast(frequent.select("digest")), "digest")).collect()
    heavy = F.broadcast(spark.createDataFrame(verified, "digest binary, group_size long, keep_id long, keep_x long"))
    hot = facts.join(heavy, "digest")
    cold = facts.join(heavy.select("digest"), "digest", "left_anti")
    groups = staged(_groups(cold).filter("group_size > 1"), "groups").withColumn("several", F.lit(True))
    alone = F.col("several").isNull()
    cold = cold.join(groups, "digest", "left").select(
        *facts.columns,
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("x")).otherwise(F.col("keep_x")).alias("keep_x"),
    )
    return hot.select(*cold.columns).unionByName(cold)


def membership(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, min_heavy: int = MIN_HEAVY
) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, digest."""
    found = _settled(staged(digests(docs, id_col, text_col), "digests"), k, min_heavy)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: of those with the winning id and
    text, one (see :func:`._rows.leave_out`). Rows are told apart by id and text, so ids may
    repeat and be null."""
    found = _settled(staged(digests(docs, id_col, text_col), "digests"), K, MIN_HEAVY)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("x") == F.col("keep_x"))
    return leave_out(docs, marks(found, stays), id_col, text_col)
