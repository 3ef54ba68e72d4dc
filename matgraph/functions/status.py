"""The derived figures of a run as columns and DataFrames over build-state rows
(label, name, pool, slots, status, started_at, finished_at, done, total, text, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matgraph.functions.figures import ACTIVE, BUILD_FIELDS, ELAPSED, ETA, FRACTION, LISTS, LOG_LINE, RUN_ELAPSED, RUN_ETA, STATUSES, filled, rounded_column
from matgraph.functions.figures import told_column as fmt_elapsed


def elapsed(now: Column) -> Column:
    return ELAPSED.column(now=now)


def fraction() -> Column:
    """Null without progress or total."""
    return FRACTION.column()


def build_eta(now: Column) -> Column:
    return ETA.column(now=now)


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def status_counts(states: DataFrame) -> DataFrame:
    """(status, n) for every status, zeros too: one aggregate row, unpivoted."""
    row = states.agg(*[_count(s).alias(s) for s in STATUSES])
    return row.unpivot([], list(STATUSES), "status", "n")


def snapshot(states: DataFrame, now: Column, run_started: Column, *more: Column) -> DataFrame:
    """One row: the counts, elapsed, eta and summary of a run, and ``more`` aggregates."""
    spent = elapsed(now)
    row = states.agg(
        *[_count(s).alias(s) for s in STATUSES],
        F.avg(F.when((F.col("status") == "done") & (spent != 0), spent)).alias("mean_s"),
        *more,
    )
    row = row.withColumn("elapsed_s", RUN_ELAPSED.column(now=now, run_started=run_started)).withColumn("eta_s", RUN_ETA.column())
    counts = F.concat_ws("  ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in STATUSES])
    rest = F.coalesce(F.concat(F.lit("  ~"), fmt_elapsed(F.col("eta_s")), F.lit(" left")), F.lit(""))
    return row.withColumn("summary", F.concat(counts, F.lit("  elapsed "), fmt_elapsed(F.col("elapsed_s")), rest)).drop("mean_s")


def running_list(states: DataFrame) -> DataFrame:
    """The running and waiting builds with their place by start, the unstarted first;
    equal starts by label. The place is a window over these rows alone, of which a run
    has no more than slots."""
    order = Window.orderBy(F.coalesce("started_at", F.lit(0.0)), "label")
    return states.filter(F.col("status").isin(*ACTIVE)).withColumn("place", F.row_number().over(order))


def transition_log(events: DataFrame, build: str, status: str, order: list[str]) -> DataFrame:
    """The events at which a build shows another status than before."""
    before = F.lag(status).over(Window.partitionBy(build).orderBy(*order))
    return events.withColumn("previous", before).filter(~F.col(status).eqNullSafe(F.col("previous")))


def last_line(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.element_at(F.split(trimmed, r"\r?\n"), -1)


def log_lines(states: DataFrame, now: Column) -> DataFrame:
    """(label, line): the text of a transition to each build's status, without the clock."""
    fields = {
        "padded": F.rpad("status", 8, " "),
        "many": F.when(F.col("slots") != 1, F.col("slots").cast("string")),
        "spent": F.when(F.col("status").isin("done", "failed") & elapsed(now).isNotNull(), fmt_elapsed(elapsed(now))),
        "last": F.when((F.col("status") == "failed"), F.nullif(last_line(F.col("error")), F.lit(""))),
    }
    parts = [F.coalesce(filled(part, lambda name: fields.get(name, F.col(name)), lambda pieces: F.concat(*pieces), F.lit), F.lit("")) for part in LOG_LINE]
    return states.filter("status <> 'pending'").select("label", F.concat(*parts).alias("line"))


def _json(value: Column) -> Column:
    """A value as JSON, ``null`` if it is unknown."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of (name, JSON); fields that are null themselves are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in fields]), F.lit("}"))


def build_json(now: Column) -> Column:
    """A build as the status document has it; empty texts are unknown."""
    fields = []
    for f in BUILD_FIELDS:
        value = f.of.column(now=now)
        value = rounded_column(value, f.digits) if f.digits else value
        known = value.isNotNull() & (value.cast("string") != "")
        fields.append((f.name, _json(value) if f.always else F.when(known, _json(value))))
    return _object(fields)


def status_json(states: DataFrame, now: Column, run_started: Column) -> DataFrame:
    """(document): the status document of a run as JSON, in one aggregate; times of the day
    are the session's. Its lists hold a run's builds, which the driver holds anyway."""
    own = states.withColumn("_build", build_json(now)).withColumn("_name", _json(F.col("name")))
    start = F.when(F.col("status").isin(*ACTIVE), F.coalesce("started_at", F.lit(0.0)))
    lists = []
    for name, statuses, whole in LISTS:
        member = F.struct(start.alias("at"), F.col("label"), F.col("_build" if whole else "_name").alias("json"))
        members = F.array_sort(F.collect_list(F.when(F.col("status").isin(*statuses), member)))
        lists.append(F.array_join(F.transform(members, lambda x: x["json"]), ",").alias(f"_{name}"))
    row = snapshot(own, now, run_started, *lists)
    day = lambda at: _json(F.date_format(F.timestamp_seconds(at), "HH:mm:ss"))
    fields = [("time", day(now)), ("started", day(run_started))]
    fields += [(k, _json(rounded_column(F.col(k), 1))) for k in ("elapsed_s", "eta_s")]
    fields += [("summary", _json(F.col("summary"))), ("counts", _object([(s, _json(F.col(s))) for s in STATUSES]))]
    fields += [(name, F.concat(F.lit("["), F.col(f"_{name}"), F.lit("]"))) for name, _, _ in LISTS]
    return row.select(_object(fields).alias("document"))
