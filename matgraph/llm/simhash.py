"""SimHash near-dedup by a self-join of binary tries.

Fingerprints: A-Z to lower case, words, 3-word shingles with repeats, XXH64 with
seed 42; a bit is 1 if it is set in over half the hashes. Equal fingerprints form
a class. Of four 16-bit blocks, two fingerprints of at most two differing bits
share at least two, so each class goes to the six buckets named by two of its
blocks. In a bucket the fingerprints form a binary trie; node pairs are
descended together, carrying the bits by which they differ, and dropped beyond
the budget. A bucket of more than ``BUCKET`` classes is cut into blocks whose
pairs become buckets of their own, so no task gets an unbounded group. What a
task finds leaves it as a spanning forest, and components are joined by hooking
and contraction.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; the shingles of a very long text are counted block by block; a document
with a null id counts as a copy of its class, and a component of null ids alone has a
null id; rows with equal ids are documents of their own; repeated rows give repeated rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import column_of, map_arrow, staged, text_of, word_blocks
from ._graph import components
from ._rows import leave_out, marks, text_key

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Classes of a bucket that one task takes at once.
BUCKET = 20_000
#: Shingle hashes that are held before their bits are counted.
FLUSH = 1 << 20
_COMBOS = list(itertools.combinations(range(4), 2))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For each byte, its bits in eight lanes of eight bits: up to 255 can be added.
_LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[list[int]]:
    """The XXH64 of each shingle, in order, as lists of bounded length."""
    tail: list[bytes] = []
    h = xxhash.xxh64_intdigest
    n = 0
    for words in word_blocks(text.translate(_LOWER)):
        n += len(words)
        words = tail + words
        if len(words) >= width:
            ends = list(itertools.accumulate(map(len, words), lambda a, w: a + w + 1, initial=0))
            joined = b" ".join(words)
            yield [h(joined[a : b - 1], SEED) for a, b in zip(ends, ends[width:])]
            tail = words[-(width - 1) :] if width > 1 else []
        else:
            tail = words
    if n and n < width:
        yield [h(b" ".join(tail), SEED)]


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document (sizes: its number of hashes, none 0), how often each of the
    64 bits is set."""
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    inner = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + inner * 255
    rows = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(sizes), 64), np.int64)
    for p in range(8):
        lanes = np.add.reduceat(_LANES[rows[:, p]], starts)
        counts[:, 8 * p : 8 * p + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts


def prints(texts: Iterable[bytes], n: int) -> np.ndarray:
    """The fingerprints of n texts."""
    counts, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    hashes: list[int] = []
    sizes: list[int] = []
    owner: list[int] = []

    def flush() -> None:
        if hashes:
            own, size = np.array(owner), np.array(sizes, np.int64)
            np.add.at(counts, own, _bit_counts(np.array(hashes, np.uint64), size))
            np.add.at(total, own, size)
        hashes.clear(), sizes.clear(), owner.clear()

    for i, text in enumerate(texts):
        for part in shingle_hashes(text):
            hashes.extend(part)
            sizes.append(len(part))
            owner.append(i)
            if len(hashes) >= FLUSH:
                flush()
    flush()
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x, fp): the fingerprint as a signed long, and what names the text."""

    def of_batches(batches):
        for batch in batches:
            fps = prints(column_of(batch, 2), batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "x", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("x"), text_of(text_col).cast("binary").alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, x long, fp long")


def trie_pairs(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of values of one group that differ in at most ``radius`` bits.

    The rows are sorted by (group, value), and differ within a group. A trie node is
    a range of rows with a common prefix; the roots are the groups.
    """
    n = len(values)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    a0, a1 = edge[:-1], edge[1:]
    big = a1 - a0 > 1
    a0, a1 = a0[big], a1[big]
    b0, b1, diff = a0, a1, np.zeros(len(a0), np.int8)
    out_a, out_b = [], []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        a_mid, b_mid = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        nexts = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            use = ~same if (x, y) == (1, 0) else np.ones(len(a0), bool)
            p0, p1 = (a_mid, a1) if x else (a0, a_mid)
            q0, q1 = (b_mid, b1) if y else (b0, b_mid)
            d = diff + (x != y)
            use &= (p1 > p0) & (q1 > q0) & (d <= radius)
            use &= ~((p0 == q0) & (p1 - p0 == 1))  # a leaf with itself
            nexts.append((p0[use], p1[use], q0[use], q1[use], d[use]))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*nexts))
        # Two leaves are compared at once; the rest of their paths can't branch.
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        p, q = a0[leaves], b0[leaves]
        near = np.bitwise_count(values[p] ^ values[q]) <= radius
        out_a.append(p[near])
        out_b.append(q[near])
        rest = ~leaves
        a0, a1, b0, b1, diff = a0[rest], a1[rest], b0[rest], b1[rest], diff[rest]
    return np.concatenate(out_a or [np.empty(0, np.int64)]), np.concatenate(out_b or [np.empty(0, np.int64)])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: nodes, and the smallest of their components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _linked(batches):
    """Edges between class representatives; the rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []

    def edges(rows: pa.Table):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        key = rows.column("bucket").to_numpy()
        rep = rows.column("rep").to_numpy()
        at = np.lexsort((fp, key))
        fp, key, rep = fp[at], key[at], rep[at]
        a, b = trie_pairs(fp, key)
        node, root = _forest(a, b, len(fp))
        return pa.RecordBatch.from_arrays([pa.array(rep[node]), pa.array(rep[root])], names=["a", "b"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 200_000:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("bucket").to_numpy()
        cut = int(np.searchsorted(key == key[-1], True))  # the last bucket may go on
        if cut:
            yield edges(rows.slice(0, cut))
            rows = rows.slice(cut)
        held, size = rows.combine_chunks().to_batches(), 0 if rows.num_rows < 200_000 else size
    if held:
        yield edges(pa.Table.from_batches(held))


def links(classes: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """(a, b): edges between the reps of ``classes`` (fp, rep) that connect all whose
    fingerprints differ in at most RADIUS bits."""
    blocks = [F.shiftrightunsigned(F.col("fp"), 48 - 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(_COMBOS)])
    keyed = classes.select("fp", "rep", F.explode(keys).alias("key"))
    large = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows), "buckets")
    plain = keyed.withColumn("bucket", F.xxhash64("key"))
    if large.limit(1).count():
        parts = keyed.join(large, "key").withColumn("m", F.ceil(2 * F.col("n") / bucket_rows).cast("int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("m").cast("long")).cast("int")
        parts = parts.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        parts = parts.withColumn("bucket", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))
        plain = plain.join(large, "key", "left_anti").select("fp", "rep", "bucket").unionByName(parts.select("fp", "rep", "bucket"))
    dealt = plain.select("bucket", "fp", "rep").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return map_arrow(dealt, _linked, "a long, b long")


def _named(facts: DataFrame) -> DataFrame:
    """(fp, root): of each fingerprint the least of its component, by which that is named."""
    prints = staged(facts.select("fp").distinct(), "classes")
    roots = components(links(prints.select("fp", F.col("fp").alias("rep"))))
    return staged(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "components")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fp, component_id."""
    facts = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _named(facts)
    least = facts.groupBy("fp").agg(F.min("doc_id").alias("id")).join(named, "fp")
    ids = least.groupBy("root").agg(F.min("id").alias("component_id"))
    return facts.join(named.join(ids, "root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null after all others), then
    the least hash of the text; of rows equal in both, one (see :func:`._rows.leave_out`). Rows
    are told apart by id and text, so ids may repeat and be null."""
    facts = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _named(facts)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "x")
    least = facts.groupBy("fp").agg(F.min(order).alias("first")).join(named, "fp")
    first = staged(least.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    found = facts.join(named.join(first, "root"), "fp")
    return leave_out(docs, marks(found, order.eqNullSafe(F.col("first"))), id_col, text_col)
