"""Connected components of an edge table, without anything of the graph on the
driver but the number of edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import scratch, staged


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root): pointers followed to their ends. Every parent is smaller than
    its node, so there are no cycles; the depth halves each time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parents = staged(
            parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), (F.col("next") < F.col("parent")).alias("moved")),
            "pointers",
        )
        moved = parents.filter("moved").limit(1).count()
        parents = parents.select("node", "parent")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, longs) that isn't
    the smallest of its component; root is that smallest node.

    Each round hooks every node to its smallest neighbour where that is smaller,
    follows the pointers, and contracts the trees, until no edge is left. Only the last
    table stays in the shared folder.
    """
    with scratch() as kept:
        found = _contracted(edges)
        kept.append(found)
    return found.select("node", F.col("parent").alias("root"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, parent), staged."""
    found: DataFrame | None = None
    rest = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        rest = staged(rest.distinct(), "edges")
        if not rest.limit(1).count():
            break
        # b has the smaller neighbour a; the smaller end of an edge never hooks to the larger.
        roots = _jumped(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        to = lambda c: roots.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        if found is None:
            found = roots
        else:
            later = roots.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            found = (
                found.join(later, "parent", "left")
                .select("node", F.coalesce("next", "parent").alias("parent"))
                .unionByName(roots.join(found.select("node"), "node", "left_anti"))
            )
        found = staged(found, "roots")
        rest = (
            rest.join(to("a"), "a", "left")
            .join(to("b"), "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        )
    return staged(rest.select(F.col("b").alias("node"), F.col("a").alias("parent")), "roots") if found is None else found
