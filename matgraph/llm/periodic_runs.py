"""Periodic runs of words by a suffix automaton, and texts with their repeats collapsed.

A run is a maximal stretch of words with smallest period q and at least EXPONENT periods and
MIN_WORDS words. Every word of a run occurs EXPONENT times within it, so a text is first cut at
words that don't occur so often in their piece, until nothing changes; what is left, of MIN_WORDS
words at least, is searched.

Each piece's suffix automaton is built word by word. Its states are taken from the longest to
the shortest, and a state's ordered set of end positions is merged into that of its suffix link,
the smaller set into the larger. Two end positions that become neighbours there, d apart, end the
same factor as long as the state is and no longer one; if d doesn't pass that length they are a
square, and here a seed if (EXPONENT - 1) * d doesn't. The factor can't be
extended to the left, so the seed's first word is its run's; the run extends to the right as far as
words d apart are equal, which is the last seed of that start and distance. Neighbours are never
two periods apart, so d is the smallest period. States too short for any run are left out.

A task holds one text's word numbers, and for the longest piece about 40 bytes a word, and 300
for each state that branches; a set is kept in blocks, so an insertion moves a bounded part.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; a
text of any length is searched whole; runs may overlap, and each is listed; every row gives one
row, repeats and null ids included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow, text_of, word_blocks

MIN_WORDS, EXPONENT = 24, 3
#: Places in a block of an ordered set.
BLOCK = 512
#: Bytes of collapsed texts that are handed on together.
HANDED = 4 << 20


def pieces(ids: np.ndarray, exponent: int = EXPONENT, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches [a, b) that hold all runs: of ``least`` words, and each word ``exponent`` times."""
    at = np.arange(len(ids))
    piece = np.zeros(len(ids), np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, code, count = np.unique(piece * width + ids[at], return_inverse=True, return_counts=True)
        often = count[code] >= exponent
        same = often[1:] & often[:-1] & (np.diff(at) == 1) & (np.diff(piece) == 0)
        piece = np.concatenate([[0], np.cumsum(~same)])
        keep = often & (np.bincount(piece)[piece] >= least)
        done = keep.all()
        at, piece = at[keep], piece[keep]
        if done:
            break
    if not len(at):
        return []
    ends = np.flatnonzero(np.diff(piece, append=piece[-1] + 1))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [(int(at[a]), int(at[b]) + 1) for a, b in zip(starts, ends)]


class Automaton:
    """The suffix automaton of a list of numbers. The first transition of a state is in ``word``
    and ``to``; those of states that branch are in ``more``."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for i, c in enumerate(words):
            last = self._extend(last, c, i)

    def _state(self, length: int, link: int, end: int, word: int = -1, to: int = -1) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.end, end), (self.word, word), (self.to, to)):
            column.append(value)
        return len(self.length) - 1

    def _follow(self, p: int, c: int) -> int:
        if self.word[p] == c:
            return self.to[p]
        rest = self.more.get(p)
        return -1 if rest is None else rest.get(c, -1)

    def _lead(self, p: int, c: int, to: int) -> None:
        if self.word[p] in (c, -1):
            self.word[p], self.to[p] = c, to
        else:
            self.more.setdefault(p, {})[c] = to

    def _extend(self, last: int, c: int, i: int) -> int:
        length, link, follow, lead = self.length, self.link, self._follow, self._lead
        own, p = self._state(length[last] + 1, 0, i), last
        while p != -1 and (q := follow(p, c)) == -1:
            lead(p, c, own)
            p = link[p]
        if p == -1:
            return own
        if length[p] + 1 == length[q]:
            link[own] = q
            return own
        copy = self._state(length[p] + 1, link[q], -1, self.word[q], self.to[q])
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p != -1 and follow(p, c) == q:
            lead(p, c, copy)
            p = link[p]
        link[q] = link[own] = copy
        return own


class Places:
    """An ordered set of end positions, in blocks."""

    __slots__ = ("blocks", "size")

    def __init__(self, place: int):
        self.blocks, self.size = [[place]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours, -1 where it has none."""
        blocks = self.blocks
        k = max(0, bisect_left(blocks, x, key=lambda b: b[0]) - 1) if len(blocks) > 1 else 0
        block = blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else -1
        after = block[at] if at < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        block.insert(at, x)
        self.size += 1
        if len(block) > BLOCK:
            blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
        return before, after


def runs_of_piece(words: list[int], exponent: int = EXPONENT, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a piece."""
    own = Automaton(words)
    length, link, end = own.length, own.link, own.end
    own.more = own.word = own.to = None  # only lengths, links and ends are needed from here
    shortest = -(-least * (exponent - 1) // exponent)
    long = np.frombuffer(length, np.int32)
    order = np.flatnonzero(long >= shortest)
    order = order[np.argsort(-long[order], kind="stable")]
    sets: dict[int, Places] = {}
    seeds: dict[tuple[int, int], int] = {}

    def add(places: Places, x: int, n: int, own: int = -1) -> None:
        """Put ``x`` in, after ``own`` of the same set, whose distance is known from there."""
        before, after = places.add(x)
        for a, b in ((before, x), (x, after)):
            d = b - a
            if a >= 0 and a != own and 0 < (exponent - 1) * d <= n and n + d >= least:
                seed = b - d - n + 1, d
                if seeds.get(seed, -1) < b:
                    seeds[seed] = b

    for v in order.tolist():
        n, places = length[v], sets.pop(v, None)
        if end[v] >= 0:
            if places is None:
                places = Places(end[v])
            else:
                add(places, end[v], n)
        n = length[up := link[v]]
        if n < shortest:
            continue
        held = sets.get(up)
        if held is None:
            sets[up] = places
            continue
        if held.size < places.size:
            held, places = places, held
            sets[up] = held
        own_last = -1
        for block in places.blocks:
            for x in block:
                add(held, x, n, own_last)
                own_last = x
    return sorted((start, last - start + 1, d) for (start, d), last in seeds.items())


def runs_of(ids: np.ndarray, exponent: int = EXPONENT, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = []
    for a, b in pieces(ids, exponent, least):
        found += [(a + start, n, d) for start, n, d in runs_of_piece(ids[a:b].tolist(), exponent, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def document(text: bytes, arrange: Callable[[int], np.ndarray | None] | None = None) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text, and the text with one period of each run, words joined by spaces.
    ``arrange`` gives, for the number of words, the places to read them from."""
    number: dict[bytes, int] = {}
    parts = [np.fromiter((number.setdefault(w, len(number)) for w in block), np.int32, len(block)) for block in word_blocks(text)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if arrange is not None and (order := arrange(len(ids))) is not None:
        ids = ids[order]
    runs = runs_of(ids)
    if runs:
        edges = np.zeros(len(ids) + 1, np.int64)
        for start, n, d in runs:
            edges[start + d] += 1
            edges[start + n] -= 1
        ids = ids[np.cumsum(edges[:-1]) == 0]
    word = list(number).__getitem__
    step = 1 << 20
    return runs, b" ".join(b" ".join(map(word, ids[at : at + step].tolist())) for at in range(0, len(ids), step))


def _rows(ids: list, found: list) -> pa.RecordBatch:
    flat = np.array([r for runs, _ in found for r in runs], np.int64).reshape(-1, 3)
    ends = np.cumsum([0, *(len(runs) for runs, _ in found)])
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array([t for _, t in found], pa.binary()).view(pa.string())],
        names=["doc_id", "runs", "collapsed"],
    )


def collapse(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): all runs of a text by start, then period, in word numbers from 0,
    and the text without what repeats in them. ``arrange(doc_id, n)`` may give, for a text of n
    words, the places of the words to search, as when a text is rewritten on the way."""

    def of_batches(batches):
        for batch in batches:
            ids, found, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(key := doc_id.as_py())
                found.append(document(text.as_py(), arrange and (lambda n, key=key: arrange(key, n))))
                size += len(found[-1][1])
                if size > HANDED:
                    yield _rows(ids, found)
                    ids, found, size = [], [], 0
            if ids:
                yield _rows(ids, found)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
