"""Rows named by id and text, so that decisions on narrow rows can be carried out on
whole ones, whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import staged, text_of

#: So many named rows (of about 50 bytes) at most are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def text_key(text_col: str = "text") -> Column:
    """What names a text beside its row's id; a null text is the empty text."""
    return F.xxhash64(text_of(text_col))


def marks(facts: DataFrame, stays: Column) -> DataFrame:
    """Of narrow rows (doc_id, x, ...) the names (id, x) that decide: those whose rows go, and
    those that stay and have several rows, of which one stays. ``stays`` is equal for rows
    of one name."""
    named = facts.groupBy(F.col("doc_id").alias("_id"), F.col("x").alias("_x")).agg(F.max(stays).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    return named.filter("not _stays or _n > 1").select("_id", "_x", "_stays")


def leave_out(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``marked`` says; of rows of a name that stays, that with
    the least hash over its columns. Texts don't move if few names are marked."""
    marked = staged(marked, "marks")
    few = marked.count() <= BROADCAST_ROWS
    side = F.broadcast(marked) if few else marked
    cols = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    plain = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)], docs[id_col].cast("long").alias("_key"), text_key(text_col).alias("_text"))
    found = plain.join(side, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_x")), "left")
    out = found.filter("_stays is null").select(*cols)
    if not marked.filter("_stays").limit(1).count():
        return out
    own = [f"_c{i}" for i in range(len(docs.columns))]
    one = found.filter("_stays").groupBy("_key", "_text").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("_row"))
    return out.unionByName(one.select("_row.*").select(*cols))
