"""Progress messages as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matgraph.functions.figures import NUMBERS

_DIGITS = r"\d+(?:_\d+)*"
#: What Python reads as a float.
FLOAT = rf"(?i)^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)\s*$"


def parse_message(message: Column) -> Column:
    """struct<id, fields>: the lines of ``KEY=VALUE``. Lines without ``=`` are skipped,
    only the first one splits, keys are trimmed, and the last of equal keys counts,
    whatever the session's policy for keys of maps: the lines are folded into a map, from
    which a key goes before it comes again."""
    lines = F.filter(F.split(message.cast("string"), "\n"), lambda x: x.contains("="))
    key = lambda x: F.regexp_replace(F.substring_index(x, "=", 1), r"^\s+|\s+$", "")
    value = lambda x: F.substr(x, F.instr(x, F.lit("=")) + 1)

    def put(fields: Column, x: Column) -> Column:
        return F.map_concat(F.map_filter(fields, lambda k, v: k != key(x)), F.create_map(key(x), value(x)))

    found = F.aggregate(lines, F.create_map().cast("map<string,string>"), put)
    return F.struct(found["ID"].alias("id"), F.map_filter(found, lambda k, v: k != "ID").alias("fields"))


def reported(fields: Column) -> Column:
    """struct<done, total, text> that a message's fields set, nulls where they set nothing. Numbers
    are read in order, up to the first that is none; the text is set all the same."""
    read, so_far = [], F.lit(True)
    for key in NUMBERS:
        said = fields[key]
        so_far = so_far & (said.isNull() | said.rlike(FLOAT))
        read.append(F.when(so_far, F.replace(F.trim(said), F.lit("_"), F.lit("")).try_cast("double")).alias(key.lower()))
    return F.struct(*read, fields["STATUS"].alias("text"))


def coalesce_last(events: DataFrame, build: str, bucket: Column, order: list[str]) -> DataFrame:
    """Of each build's events the last in each bucket of time: what the channel's
    throttling leaves. Partial maxima go to the shuffle, not events."""
    last = F.max_by(F.struct(*[F.col(c) for c in events.columns]), F.struct(*order)).alias("_last")
    found = events.withColumn("bucket", bucket).groupBy(build, "bucket").agg(last)
    return found.select(*[F.col("_last")[c].alias(c) for c in events.columns], "bucket")


def latest_state(events: DataFrame, build: str, fields: list[str], order: list[str]) -> DataFrame:
    """Fold events into one row for each build: the last value of each field that is not
    null. Partial maxima go to the shuffle, not events."""
    at = F.struct(*order)
    return events.groupBy(build).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields], F.count(F.lit(1)).alias("n_events")
    )
