"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors (those with the least MD5 of the id: a bounded sample) order
every vector by nearness; a vector is represented by its ``PREFIX`` nearest pivots
in order. Vectors are dealt by a hash into blocks of about ``BLOCK``; a block's
vectors are posted, with the rank of the pivot, in inverted files, one for each
pivot. A query walks the files of its own nearest pivots, adding up Spearman's
footrule (a pivot that only one side has costs what is missing); the ``SHARE`` of
the block with the least footrule, ``LEAST`` at least, is reranked by the inner
product on the original vectors, and the best of all blocks are merged.

For inner products of vectors of any length, vectors are lifted onto a sphere by
one more coordinate, and queries get zero there; the order of the pivots by
distance is then that by inner product.

Every row is indexed, and every query meets every block: nothing is left out but
what ranks low. Ties go to the smaller id, among equal footrules too, so copies of
one vector don't hide each other's smallest ids.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; rows with a null id neither;
rows that repeat an id and a vector count once; an id of several vectors is searched with
each, and found with each score; rows that repeat a query's id are not its neighbours; a
query without other candidates gives no row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import map_arrow, staged

PIVOTS = 1024
PREFIX = 64
BLOCK = 8192
SHARE, LEAST = 0.2, 400
#: Queries that a block's index serves before it is built again elsewhere.
QUERIES = 100_000
#: Tasks at most; beyond, a task goes through several cells one after another.
PARTITIONS = 20_000


def _rows(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class Pivots:
    def __init__(self, vectors: np.ndarray, radius: float):
        self.radius = radius
        self.lifted = self.lift(vectors)
        self.prefix = min(PREFIX, len(vectors))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def order(self, points: np.ndarray) -> np.ndarray:
        """The nearest pivots of lifted points, nearest first."""
        out = np.empty((len(points), self.prefix), np.int64)
        for at in range(0, len(points), 1024):
            s = -(points[at : at + 1024] @ self.lifted.T)
            near = np.argpartition(s, self.prefix - 1, axis=1)[:, : self.prefix]
            inner = np.argsort(np.take_along_axis(s, near, 1), axis=1, kind="stable")
            out[at : at + 1024] = np.take_along_axis(near, inner, 1)
        return out


class Block:
    """The inverted files of a block; ids ascend."""

    def __init__(self, pivots: Pivots, ids: np.ndarray, vectors: np.ndarray):
        self.pivots, self.ids, self.vectors = pivots, ids, vectors
        self.quick = vectors.astype(np.float32)
        order = pivots.order(pivots.lift(vectors))
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots.lifted) + 1)).tolist()
        self.member = by_pivot // pivots.prefix
        self.rank = (by_pivot % pivots.prefix).astype(np.float64)
        self.take = max(LEAST, int(SHARE * len(ids)))

    def candidates(self, order: np.ndarray) -> np.ndarray:
        if self.take >= len(self.ids):
            return np.arange(len(self.ids))
        n = self.pivots.prefix
        files = [slice(self.starts[j], self.starts[j + 1]) for j in order.tolist()]
        member = np.concatenate([self.member[f] for f in files])
        rank = np.concatenate([self.rank[f] for f in files])
        own = np.repeat(np.arange(n), [f.stop - f.start for f in files])
        # What a shared pivot saves against one that only the query has and one that only
        # the vector has.
        saved = np.bincount(member, 2 * n - own - rank - np.abs(own - rank), len(self.ids))
        key = -saved * len(self.ids) + np.arange(len(self.ids))  # ties: the smaller id
        return np.argpartition(key, self.take)[: self.take]

    def best(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but the query itself."""
        c = self.candidates(order)
        c = c[self.ids[c] != query_id]
        if len(c) > 2 * k:
            rough = self.quick[c] @ query.astype(np.float32)
            floor = np.partition(rough, len(c) - k)[len(c) - k]
            slack = 1e-5 * (1 + np.abs(query).max() * self.pivots.radius) * np.sqrt(len(query))
            c = c[rough >= floor - slack]
        score = (self.vectors[c] * query).sum(axis=1)  # the same sum for equal vectors
        top = np.lexsort((self.ids[c], -score))[:k]
        return self.ids[c][top], score[top]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that
    ``is_query`` (on vec_id) picks, out of all other rows."""
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    good = given.filter(~F.exists("v", bad)).withColumn("norm", F.sqrt(length)).filter("norm > 0 and norm < double('Infinity')")
    good = staged(good.dropDuplicates(["vec_id", "v"]), "vectors")
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("radius"))
    size = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    good = good.filter(F.size("v") == size["size"])
    dims, radius = size["size"], size["radius"]
    chosen = good.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(PIVOTS).select("v").collect()
    pivots = spark.sparkContext.broadcast(Pivots(np.array([r["v"] for r in chosen]), radius))
    # The grid: each block of vectors against each group of queries.
    blocks = max(1, -(-size["n"] // BLOCK))
    groups = max(1, -(-good.filter(is_query).count() // QUERIES))
    cell = lambda b, g: (b * groups + g).cast("long").alias("cell")
    of = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = good.withColumn("b", of(blocks, "block")).withColumn("g", every(groups)).select(cell(F.col("b"), F.col("g")), F.lit(0).alias("kind"), "vec_id", "v")
    queries = good.filter(is_query).withColumn("g", of(groups, "group")).withColumn("b", every(blocks)).select(cell(F.col("b"), F.col("g")), F.lit(1).alias("kind"), "vec_id", "v")
    # By range, as a hash would put several of few cells into one task.
    parts = min(blocks * groups, PARTITIONS)
    dealt = vectors.unionByName(queries)
    dealt = dealt.repartitionByRange(parts, "cell") if parts > 1 else dealt.repartition(1)
    dealt = dealt.sortWithinPartitions("cell", "kind", "vec_id")

    def search(batches):
        held: list[pa.RecordBatch] = []
        block, now = None, None
        for batch in batches:
            cell_of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tag = cell_of * 2 + kind
            cuts = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1], [True]))) if len(tag) else []
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if cell_of[a] != now:
                    held, block, now = [], None, cell_of[a]
                if kind[a] == 0:
                    held.append(part)
                    continue
                if block is None:
                    rows = pa.Table.from_batches(held) if held else None
                    ids = rows.column(2).to_numpy() if held else np.empty(0, np.int64)
                    block = Block(pivots.value, ids, _rows(rows.column(3), dims) if held else np.empty((0, dims)))
                    held = []
                ids, points = part.column(2).to_numpy(), _rows(part.column(3), dims)
                orders = pivots.value.order(np.concatenate([points, np.zeros((len(points), 1))], axis=1))
                out = [block.best(i, p, o, k) for i, p, o in zip(ids, points, orders)]
                yield pa.RecordBatch.from_arrays(
                    [np.repeat(ids, [len(o[0]) for o in out]), np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])],
                    names=["query_id", "vec_id", "score"],
                )

    found = map_arrow(dealt, search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id's vectors may find one row, of one score, several times.
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
