"""The scheduler's decisions as relations, for build graphs kept as tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from matgraph.operators.scratch import new_folder


def _written(df: DataFrame, folder: str, name: str) -> tuple[DataFrame, int]:
    """``df`` as a table below the shared folder, and the number of its rows, in one job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"), seen.get["n"]


def _jumped(single: DataFrame, folder: str) -> DataFrame:
    """(node, up) of nodes with one dependency: the first node that isn't one of them on the way
    down. Pointers are followed by four times as far in each job, those that have arrived stay."""
    others = single.select(F.col("node").alias("up"), F.lit(False).alias("ends"))
    pointers = single.select("node", F.col("dep").alias("up")).join(others, "up", "left").select("node", "up", F.coalesce("ends", F.lit(True)).alias("ends"))
    pointers, n = _written(pointers, folder, "pointers0")
    # On a ring, which no graph of steps has, pointers never arrive, and so reach nothing.
    for k in range(1, 2 + math.ceil(math.log(max(n, 1), 4))):
        moving = pointers.filter("not ends")
        if not moving.limit(1).count():
            break
        way = pointers.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("ends").alias("done"))
        for _ in range(3):  # a pointer that has arrived isn't found by the next join, and stays
            moving = moving.join(way, F.when(~F.col("ends"), moving["up"]) == way["up"], "left").select(
                "node", F.coalesce("next", moving["up"]).alias("up"), F.coalesce("done", "ends").alias("ends")
            )
        pointers, _ = _written(pointers.filter("ends").unionByName(moving), folder, f"pointers{k}")
    return pointers.filter("ends").select("node", "up")


def blocked_closure(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(node): all that depend on a failed node, directly or not, and didn't fail.

    Nodes with one dependency are blocked by what their chain comes down to: a failed node, or
    one with several dependencies. Chains are followed by pointer jumping, in a number of jobs
    that grows with the logarithm of their length. What is left are nodes with several
    dependencies, joined to the ends of these chains; they are met breadth first, a job for a level
    of such nodes, where each level drops what is known, so diamonds don't multiply rows. Tables
    are in a folder below the session's shared folder, which survives lost executors and keeps
    plans small.
    """
    folder = new_folder(edges.sparkSession, "closure")
    failed = failed.select("node").distinct()
    open_ = edges.select("node", "dep").distinct().join(failed, "node", "left_anti")
    n_deps = open_.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    ups = _jumped(n_deps.filter("n = 1").select("node", "dep"), folder)
    several = open_.join(n_deps.filter("n > 1").select("node"), "node", "left_semi")
    ends = ups.select(F.col("node").alias("dep"), "up")
    several, n = _written(several.join(ends, "dep", "left").select("node", F.coalesce("up", "dep").alias("dep")).distinct(), folder, "several")
    hit = failed
    if n:
        known, fresh = failed, failed
        for depth in itertools.count():
            above = several.join(fresh.withColumnRenamed("node", "dep"), "dep").select("node").distinct().join(known, "node", "left_anti")
            fresh, n = _written(above, folder, f"level{depth}")
            known = edges.sparkSession.read.schema(above.schema).parquet(*[f"{folder}/level{k}" for k in range(depth + 1)])
            if not n:
                break
        hit = failed.unionByName(known)
    by_chain = ups.join(hit.withColumnRenamed("node", "up"), "up", "left_semi").select("node")
    return by_chain.unionByName(hit.join(failed, "node", "left_anti"))


def ready_set(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """(node): not done, and without a dependency that isn't done."""
    waiting = edges.join(done.select(F.col("node").alias("dep")), "dep", "left_anti").select("node")
    return nodes.select("node").join(done, "node", "left_anti").join(waiting, "node", "left_anti")


def slot_admission(candidates: DataFrame, budget: int) -> DataFrame:
    """(node, pool, slots) of the candidates that start together: in each pool by node,
    those that still fit; one that doesn't is skipped, and later ones may pass it.

    The fold needs a pool's candidates in order. At most ``budget`` of one-slot steps
    can be admitted, and as a step takes at least one slot, of each number of slots no
    more than budget/slots, so only the first so many of each kind are gathered.
    """
    kind = Window.partitionBy("pool", "slots").orderBy("node")
    few = candidates.filter(F.col("slots") <= budget).withColumn("_n", F.row_number().over(kind))
    # The first condition cuts before the shuffle, the second exactly.
    few = few.filter((F.col("_n") <= budget) & (F.col("_n") * F.col("slots") <= budget))
    in_order = F.array_sort(F.collect_list(F.struct("node", "slots")))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<node:bigint,slots:int>>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["slots"] <= budget
        return F.when(
            fits, F.struct((acc["used"] + x["slots"]).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))
        ).otherwise(acc)

    pools = few.groupBy("pool").agg(in_order.cast("array<struct<node:bigint,slots:int>>").alias("given"))
    taken = pools.select("pool", F.explode(F.aggregate("given", empty, step)["taken"]).alias("t"))
    return taken.select("t.node", "pool", "t.slots")
