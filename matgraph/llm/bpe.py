"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Every partition streams its texts through one in-memory DuckDB database that
holds the merge table (left id, right id, merged id = rank). The pieces of the
pattern that the partition's cache doesn't know become token-position rows; a
recursive query joins neighbouring positions with the merge table and contracts
each piece's leftmost pair of least rank, until no piece has one. An ordered
aggregation gives each piece's ids. Decoding joins the (text, position, id) rows of
every text to the vocabulary and aggregates them in order.
The pattern is applied by the ``regex`` module, as DuckDB's engine has no
lookahead. Nothing is shuffled; memory is bounded by ``BLOCK`` characters of
pieces, ``WORK`` rows of a recursion, ``TOKENS`` rows and ``DECODED`` bytes of a decoding,
``CACHE`` cached pieces, ``WINDOW`` bytes of long ones, DuckDB's own limit, and one text.

The recursion keeps every step, so a piece of n bytes makes up to n * n / 2 rows and takes
quadratic time. Those of more than ``LONG`` bytes (an unbroken run of letters, say) are
contracted by the same rule on arrays, in windows that are joined where they agree, and
aren't cached.

Defined results: a null text is the empty text, with no tokens; a very long text is
encoded and decoded in parts; every row gives one row, repeats and null ids included; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow, text_of

#: Characters of text whose pieces are held at once.
BLOCK = 4 << 20
#: Pieces in each of the cache's two generations.
CACHE = 200_000
LONG = 128
#: Pieces that go through one recursive query, and rows that it may make.
QUERY, WORK = 20_000, 2_000_000
#: Tokens that are decoded by one query, and bytes that they become.
TOKENS, DECODED = 500_000, 4 << 20
#: Bytes of long pieces that are contracted together, on arrays of about 40 bytes for each.
WINDOW = 1 << 20
NONE = np.iinfo(np.int32).max

#: key is the piece's number and the token's place in it, which stays dense: a step
#: contracts one pair of each piece that still has one.
ENCODE = """
WITH RECURSIVE step(it, key, id) AS (
  SELECT 0, key, id FROM seed
  UNION ALL
  SELECT s.it + 1, s.key - (s.key > best.at)::INTEGER, CASE WHEN s.key = best.at THEN best.merged ELSE s.id END
  FROM step s JOIN
    (SELECT a.key >> 16 AS piece, (a.key >> 16 << 16) + (min(m.merged << 16 | (a.key & 65535)) & 65535) AS at,
            min(m.merged << 16 | (a.key & 65535)) >> 16 AS merged
     FROM step a JOIN step z ON z.key = a.key + 1 JOIN merges m ON m.pair = a.id << 16 | z.id
     GROUP BY a.key >> 16) best ON best.piece = s.key >> 16
  WHERE s.key <> best.at + 1
),
last AS (SELECT key >> 16 AS piece, max(it) AS it FROM step GROUP BY 1)
SELECT list(s.id ORDER BY s.key) AS ids
FROM step s JOIN last ON last.piece = s.key >> 16 AND last.it = s.it
GROUP BY s.key >> 16 ORDER BY s.key >> 16
"""

#: The vocabulary's bytes as characters of that number, as a token may end within a character.
DECODE = """
SELECT doc, string_agg(v.chars, '' ORDER BY pos) AS chars
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY doc ORDER BY doc
"""


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


class Codec:
    """The vocabulary in a DuckDB database of this process, and a cache of pieces."""

    def __init__(self, file: bytes, pattern: str):
        import duckdb

        self.ranks = read_ranks(file)
        self.find = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": ""})
        get = self.ranks.get
        merges = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None
        ]
        m = np.array(merges, np.int64).reshape(-1, 3)
        by = np.argsort(m[:, 0] << 16 | m[:, 1])
        self.pairs = np.append((m[:, 0] << 16 | m[:, 1])[by], np.iinfo(np.int64).max)
        self.merged = np.append(m[:, 2][by], NONE).astype(np.int32)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.lengths[list(self.ranks.values())] = list(map(len, self.ranks))
        for name, rows in (
            ("merges", pa.table({"pair": m[:, 0] << 16 | m[:, 1], "merged": m[:, 2]})),
            ("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "chars": [b.decode("latin-1") for b in self.ranks]})),
        ):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each two ids merge to, NONE where nothing does."""
        key = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.pairs, key)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.merged[at], NONE)

    def _contract_together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of several pieces, by the recursion's rule, rank by rank on arrays: all leftmost
        pairs of the least rank at once, as long as none of them makes a pair of a lesser one."""
        raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        ids = self.byte_ids[raw].astype(np.int32)
        ids[ends] = -1  # a place that merges with nothing
        after = np.arange(1, len(ids) + 1, dtype=np.int32)
        after[-1] = len(ids) - 1
        prior = np.arange(-1, len(ids) - 1, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank != NONE], rank[rank != NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(own)

        at = np.arange(len(ids) - 1, dtype=np.int32)
        wait(at, self._ranks_of(ids[:-1], ids[1:]))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[self._ranks_of(ids[at], ids[after[at]]) == r]
            if not len(at):
                continue
            # Of pairs that overlap, every second one from the left.
            new = np.r_[True, after[at[:-1]] != at[1:]]
            place = np.arange(len(at))
            every, at = at, at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            gone = after[at]
            left = np.where(np.r_[False, prior[at[1:]] == gone[:-1]], r, ids[prior[at]])
            lesser = np.minimum(self._ranks_of(left, np.full(len(at), r)), self._ranks_of(np.full(len(at), r), ids[after[gone]])) < r
            if lesser.any():
                k = int(lesser.argmax()) + 1
                waiting[r] = [every]
                heapq.heappush(ranks, r)
                at, gone = at[:k], gone[:k]
            ids[at], ids[gone] = r, -2
            after[at] = after[gone]
            prior[after[at]] = at
            both = np.r_[prior[at], at]
            wait(both, self._ranks_of(ids[both], ids[after[both]]))
        return [part[part >= 0] for part in np.split(ids, ends)[:-1]]

    def _contract_long(self, piece: bytes) -> bytes:
        """The packed ids of a piece in windows of WINDOW bytes, each of which begins at a token
        of the one before. Of two windows that hold one token at one place, the first's ids up to it
        and the second's after it are those of both together: ids are a contraction if every two
        neighbours are, as a merge across neighbours would come first among these two as well."""
        out: list[bytes] = []
        held, at = self._contract_together([piece[:WINDOW]])[0], 0
        while at + WINDOW < len(piece):
            starts = at + np.r_[0, np.cumsum(self.lengths[held[:-1]])]
            back = 32
            while True:
                # The last tokens of a window may hang on what follows it.
                k = max(0, len(held) - back)
                more = self._contract_together([piece[starts[k] : starts[k] + WINDOW]])[0] if k else None
                if k == 0 or more[0] == held[k]:
                    break
                back *= 2
            if k == 0:  # no two windows agree
                more = self._contract_together([piece[at:]])[0]
                return b"".join([*out, more.astype("<u4").tobytes()])
            out.append(held[:k].astype("<u4").tobytes())
            held, at = more, int(starts[k])
        return b"".join([*out, held.astype("<u4").tobytes()])

    def learn(self, pieces: Iterable[str]) -> None:
        """Bring all these pieces into the young generation, as packed ids."""
        missing: list[tuple[int, bytes, str]] = []
        long: list[tuple[int, bytes, str]] = []
        young, old, rank_of = self.young, self.old, self.ranks.get
        for p in set(pieces).difference(young):
            if (known := old.get(p)) is None:
                raw = p.encode()
                if (rank := rank_of(raw)) is not None:
                    known = rank.to_bytes(4, "little")
                elif len(raw) <= LONG:
                    missing.append((len(raw), raw, p))
                    continue
                else:
                    long.append((len(raw), raw, p))
                    continue
            young[p] = known
        self._learn_long(sorted(long))
        # Pieces of like length together, as many as WORK allows.
        missing.sort()
        at = 0
        while at < len(missing):
            end, work = at, 0
            while end < len(missing) and end - at < QUERY and (end == at or work + missing[end][0] ** 2 // 2 <= WORK):
                work += missing[end][0] ** 2 // 2
                end += 1
            self._contract(missing[at:end])
            at = end

    def _learn_long(self, given: list[tuple[int, bytes, str]]) -> None:
        self.long += (p for _, _, p in given)
        at = 0
        while at < len(given):
            end, size = at + 1, given[at][0]
            while end < len(given) and size + given[end][0] <= WINDOW:
                size += given[end][0]
                end += 1
            if size > WINDOW:
                self.young[given[at][2]] = self._contract_long(given[at][1])
            else:
                for (_, _, p), ids in zip(given[at:end], self._contract_together([raw for _, raw, _ in given[at:end]])):
                    self.young[p] = ids.astype("<u4").tobytes()
            at = end

    def _contract(self, given: list[tuple[int, bytes, str]]) -> None:
        n = np.fromiter((k for k, _, _ in given), np.int64, len(given))
        wid = np.repeat(np.arange(len(given)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        raw = np.frombuffer(b"".join(r for _, r, _ in given), np.uint8)
        self.db.register("seed", pa.table({"key": wid << 16 | pos, "id": self.byte_ids[raw]}))
        got = self.db.sql(ENCODE).to_arrow_table().column(0).combine_chunks()
        self.db.unregister("seed")
        ids, ends = got.values.to_numpy().astype("<u4").tobytes(), got.offsets.to_numpy().tolist()
        for (_, _, p), a, b in zip(given, ends, ends[1:]):
            self.young[p] = ids[4 * a : 4 * b]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of each list of packed ids."""
        ends = np.cumsum([len(t) // 4 for t in texts])
        flat = np.frombuffer(b"".join(texts) if len(texts) != 1 else texts[0], "<u4")
        out: list[list[bytes]] = [[] for _ in texts]
        at = 0
        while at < len(flat):
            # Tokens of so many bytes as DECODED says, or one.
            ids = flat[at : at + TOKENS].astype(np.int32)
            ids = ids[: max(1, int(np.searchsorted(np.cumsum(self.lengths[ids]), DECODED, side="right")))]
            doc = np.searchsorted(ends, np.arange(at, at + len(ids)), side="right").astype(np.int32)
            at += len(ids)
            self.db.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for i, chars in zip(got.column(0).to_pylist(), got.column(1)):
                out[i].append(chars.as_py().encode("latin-1"))
        return [b"".join(parts) for parts in out]

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.find.findall(text)
            return
        held, size = [], 0
        for m in self.find.finditer(text):
            held.append(m[0])
            size += len(held[-1])
            if size > BLOCK or len(held) > BLOCK // 4:
                yield held
                held, size = [], 0
        yield held

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as packed little-endian unsigned 32-bit integers.
        ``texts`` holds about BLOCK characters or is one."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            return [b"".join(self._joined([block])[0] for block in self.pieces(texts[0]))]
        return self._joined([self.find.findall(t) for t in texts])

    def _joined(self, found: list[list[str]]) -> list[bytes]:
        self.learn(itertools.chain.from_iterable(found))
        get = self.young.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in found]
        for p in self.long:
            del self.young[p]
        self.long.clear()
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return out


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(file: bytes, pattern: str) -> Codec:
    """One for each process and vocabulary: Spark's workers are used again."""
    key = (hash(file), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(file, pattern)
    return _CODECS[key]


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as packed little-endian unsigned 32-bit integers, and
    the bytes they decode to. ``vocabulary`` is the content of a rank file; it is
    broadcast (its size does not depend on the data)."""
    file = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of_batches(batches):
        own = codec(file.value, pattern)
        for batch in batches:
            at = 0
            for block in _blocks(x.as_py() for x in batch.column(1)):
                ids = own.encode(block)
                decoded = own.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
                )
                at += len(block)
        own.old.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, ids binary, decoded binary")


def decode(rows: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, decoded) from the (doc_id, ids) that :func:`encode` gives; null ids
    decode to nothing."""
    file = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def of_batches(batches):
        own = codec(file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode(ids), pa.binary())], names=["doc_id", "decoded"])

    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), of_batches, "doc_id long, decoded binary")
