"""Source divergence audit: how far each source's use of terms is from the other sources of
its language, over integer-encoded terms in exact arithmetic.

Texts are read once. Each task counts the terms of its (language, source) groups and hands on
(language, source, term, occurrences, documents); these rows meet by (language, term), so a
hot source is spread over its terms, and terms in fewer than MIN_DOCS documents of the language go.
The rest are numbered in UTF-8 order and cut into chunks. A chunk's sorted kept terms are an
array, searchsorted gives ids that keep that order, and bincount makes a dense vector of each group. From these come the chunk's part of each pair's sum, and of each group the chunk's
TOP terms by value and id. No list of groups or terms passes through the driver.

A group's smoothed share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), for V kept terms
of the language with N occurrences in the group; a value is floor((p - q)^2 / q). Part ``pair``
sums it over all kept terms against each other source of the language, part ``term`` has it against
the language as a whole, for terms that the group uses more than it. Arithmetic is on 64-bit integers,
exact for up to 9e12 occurrences of a language and 2e9 kept terms.

Memory is bounded by FLUSH counted entries (and the distinct terms of one text) in the first pass,
and by a chunk of about ROWS rows, or as many as pairs of sources, and CELLS cells in the second.

Defined results: null texts, languages and sources are the empty string; every group that occurs is
there, with values of 0 if its language keeps no term; repeated rows are rows, and ids aren't used;
a term or text of any length counts whole; equal values rank by item in UTF-8 order; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import map_arrow, staged, word_blocks

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
FLUSH, ROWS, CELLS = 300_000, 100_000, 1 << 20

#: Bytes of no term become spaces, A-Z small letters; those of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms in order, as lists from blocks of the text."""
    return word_blocks(text.translate(_TERMS))


def _counted(batches):
    """(lang, source, text) to (lang, source, term, n, docs), with an empty term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array([source] * size), pa.array(list(n), pa.binary()).view(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            if (group := held.get((lang, source))) is None:
                group = held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
            before = len(group[0])
            seen: set[bytes] = set()
            for found in terms_of(text.as_py()):
                group[0].update(found)
                seen.update(found)
            group[1].update(seen)
            size += len(group[0]) - before
            if size > FLUSH:
                yield from rows()
                size = 0
    yield from rows()


def counts_of(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, first): occurrences of the kept terms in each group, and an empty
    term for each group; ``first`` marks one row of each kept term of a language."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = docs.select(own("lang"), own("source"), own("text").cast("binary").alias("text"))
    parts = map_arrow(given, _counted, "lang string, source string, term string, n long, docs long")
    sums = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"all": F.sum("docs").over(of_term), "first": (F.row_number().over(of_term.orderBy("source")) == 1) & (F.col("term") != "")})
    return sums.filter((F.col("all") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "first")


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in thousands, as the product may
    pass 64 bits."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return ((d * d).view(np.uint64) // q.view(np.uint64)).view(np.int64)


def _sorted_ids(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in UTF-8 order, and each value's place among them."""
    codes = values.combine_chunks().dictionary_encode()
    words = np.empty(len(codes.dictionary), object)
    words[:] = [w.encode() for w in codes.dictionary.to_pylist()]
    kept = np.sort(words)
    return kept, np.searchsorted(kept, words)[codes.indices.to_numpy()]


def _chunk(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """The parts of a chunk's pairs and its best terms, from its rows (source, term, n) and all
    the language's groups (source, total, kept)."""
    names, place = _sorted_ids(groups.column("source"))
    total = np.zeros((len(names), 1), np.int64)
    total[place, 0] = groups.column("total").to_numpy()
    kept_terms = int(groups.column("kept")[0].as_py())
    terms, ids = _sorted_ids(counts.column("term"))
    group = np.searchsorted(names, np.array([s.encode() for s in counts.column("source").to_pylist()], object))
    n = counts.column("n").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, group, n = ids[order], group[order], n[order]
    pairs = np.zeros((len(names), len(names)), np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
    step = max(1, CELLS // len(names))
    for at in range(0, len(terms), step):
        width = min(step, len(terms) - at)
        own = slice(*np.searchsorted(ids, [at, at + width]))
        count = np.bincount(group[own] * width + ids[own] - at, weights=n[own], minlength=len(names) * width).astype(np.int64).reshape(len(names), width)
        p = shares(count, total + kept_terms)
        whole = shares(count.sum(axis=0), total.sum() + kept_terms)
        for g in range(len(names)):
            pairs[g] += _spread(p[g], p).sum(axis=1)
            more = np.flatnonzero((count[g] > 0) & (p[g] > whole))
            value = np.concatenate([best[g][0], _spread(p[g, more], whole[more])])
            at_id = np.concatenate([best[g][1], more + at])
            top = np.lexsort((at_id, -value))[:TOP]
            best[g] = value[top], at_id[top]
    rows: list[tuple] = [(names[a], "pair", names[b], pairs[a, b]) for a in range(len(names)) for b in range(len(names)) if a != b]
    rows += [(names[g], "term", terms[i], v) for g in range(len(names)) for v, i in zip(*best[g])]
    source, part, item, value = zip(*rows) if rows else ((), (), (), ())
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "source": pa.array(source, pa.binary()).view(pa.string()),
        "part": pa.array(part, pa.string()), "item": pa.array(item, pa.binary()).view(pa.string()), "value": pa.array(value, pa.int64()),
    })


def _numbered(batches):
    """Of rows in the order of terms, the number of each term in its part, from 0."""
    at = -1
    for batch in batches:
        local = at + np.cumsum(batch.column("first").to_numpy(zero_copy_only=False))
        at = int(local[-1]) if len(local) else at
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(local, pa.int64())], names=[*batch.schema.names[:5], "local"])


def _encoded(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, chunk, source, term, n). Terms are numbered in the order of languages and terms: within
    ranges, whose sizes are added up, so that chunks don't hang on how the rows are dealt."""
    facts = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("first").cast("long")).alias("terms")).first()
    most = groups.agg(F.max("sources")).first()[0] or 0
    # A chunk gives a row for each pair of sources, so it has as many rows to read at least.
    width = max(1, max(ROWS, most * most) * (facts["terms"] or 0) // max(1, facts["rows"]))
    ranges = kept.repartitionByRange(max(1, math.ceil(facts["rows"] / ROWS)), "lang", "term").sortWithinPartitions("lang", "term", "source")
    ranges = ranges.select(F.spark_partition_id().alias("part"), "lang", "source", "term", "n", "first")
    ranges = staged(map_arrow(ranges, _numbered, "part int, lang string, source string, term string, n long, local long"), "numbered")
    sizes = ranges.groupBy("part").agg((F.max("local") + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("part").alias("part"), before.alias("before"))
    ranges = ranges.join(sizes, "part")
    return ranges.select("lang", F.floor((F.col("before") + F.col("local")) / width).alias("chunk"), "source", "term", "n")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank); ``top`` (at most TOP) terms of each group."""
    counts = staged(counts_of(docs, min_docs), "counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.count(F.lit(1)).alias("sources"))
    groups = staged(groups.join(langs, "lang").drop("firsts"), "groups")
    dealt = staged(_encoded(counts.filter("term <> ''"), groups), "chunks")
    around = staged(dealt.select("lang", "chunk").distinct().join(groups, "lang"), "around")
    parts = dealt.groupBy("lang", "chunk").cogroup(around.groupBy("lang", "chunk")).applyInArrow(_chunk, "lang string, source string, part string, item string, value long")
    parts = staged(parts, "parts")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    found = [x.withColumn("rank", rank) for x in (pairs, parts.filter("part = 'term'"))]
    return found[0].unionByName(found[1].filter(F.col("rank") <= min(top, TOP)))
