"""A bounded, repeatable sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import BATCHES, options


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: fixes the folds. Null ids are in 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


#: Classes at most that a sample has: the most frequent labels.
CLASSES = 200


def labelled_sample(labels: DataFrame, docs: DataFrame, per_label: int, chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` of the rows (doc_id, label) of each label,
    those with the least MD5 of the id, with their whole texts from ``docs``; fewer where the
    texts before a row, in that order, have ``chars`` characters together. The choice is
    made on narrow rows; of the texts only the chosen ones move. Of ids that repeat, equal
    texts count once. What is collected is bounded by CLASSES, ``per_label`` and
    ``chars``, and one text."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    narrow = labels.filter("label is not null and doc_id is not null").select("doc_id", "label")
    # About twice the wanted number pass the first draw, whatever the number of rows, so
    # that a label's window isn't given more by more tasks.
    counts = narrow.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(CLASSES)
    counts = counts.select("label", ((2.0 * per_label + 100.0) / F.col("n")).alias("share"))
    drawn = narrow.join(F.broadcast(counts), "label").filter(uniform < F.col("share"))
    order = Window.partitionBy("label").orderBy(digest, "doc_id")
    chosen = drawn.dropDuplicates(["doc_id", "label"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = texts.withColumn("x", F.xxhash64("text"))
    # Which texts come is settled on their hashes and lengths, so that repeats of an id don't move whole.
    facts = texts.join(F.broadcast(chosen.select("doc_id", "label", "n")), "doc_id").groupBy("doc_id", "label", "n", "x").agg(F.max(F.length("text")).alias("size"))
    before = Window.partitionBy("label").orderBy("n", "x").rowsBetween(Window.unboundedPreceding, -1)
    taken = facts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("before") < chars)
    with options(docs.sparkSession, BATCHES):
        taken = taken.select("doc_id", "label", "x").collect()
        labels_of: dict[tuple, list] = {}
        for r in taken:
            labels_of.setdefault((r["doc_id"], r["x"]), []).append(r["label"])
        wanted = docs.sparkSession.createDataFrame(list(labels_of), "doc_id long, x long")
        found = texts.join(F.broadcast(wanted), ["doc_id", "x"]).groupBy("doc_id", "x").agg(F.first("text").alias("text"))
        rows = [(r["doc_id"], r["x"], r["text"], label) for r in found.collect() for label in labels_of[r["doc_id"], r["x"]]]
    return [(text, label) for _, _, text, label in sorted(rows, key=lambda r: (r[0], r[1], str(r[3])))]
