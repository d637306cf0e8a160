"""Hierarchical multi-length packing of token ids into sequences.

Each document's whole windows of the longest context stand alone.  What is left is routed to the shortest context tier
that holds it.  Tiers are packed from the longest down: a window opens with the largest piece of its tier, its gap is
filled with the largest pieces of shorter tiers that fit, and the last bit is cut from the smallest piece that is left.
So every sequence is full; what remains at the end of an input split is cut into sequences of falling powers of two.
Sequences are then dealt to step groups of equal tokens, each with the split's mix of tiers.

Splits are packed where they are read: no row is shuffled, and a task holds a bounded pool of pieces besides the longest
text.  ``sequence_id`` and ``step_group`` are unique over all splits.

Edge cases: null or empty texts are the end id alone; null doc_ids and repeated rows are packed like others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import wordbpe
from alphaloom.llm.common import batch

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
POOL_IDS = 1 << 20           # ids gathered before the pool is packed
STEP_IDS = 1 << 16           # ids of a step group
ROWS = 256
MEMO = 200_000               # chunks a worker remembers, beside the pool


class Pool:
    """Pieces (doc_id, start, ids, doc_tokens) by length."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.items: dict[int, tuple] = {}
        self.total = self.n = 0

    def put(self, piece: tuple) -> None:
        self.n += 1
        insort(self.keys, (len(piece[2]), self.n))
        self.items[self.n] = piece
        self.total += len(piece[2])

    def _pop(self, i: int) -> tuple:
        size, n = self.keys.pop(i)
        self.total -= size
        return self.items.pop(n)

    def largest(self, most: int | None = None) -> tuple | None:
        """The largest piece (of at most so many ids)."""
        i = (len(self.keys) if most is None else bisect_right(self.keys, (most, self.n + 1))) - 1
        return self._pop(i) if i >= 0 else None

    def smallest(self) -> tuple:
        return self._pop(0)

    def longest_is_over(self, size: int) -> bool:
        return bool(self.keys) and self.keys[-1][0] > size


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def window(pool: Pool, size: int) -> list[tuple]:
    """A full sequence of ``size`` ids; the pool must hold as many."""
    out, gap = [], size
    while gap:
        piece = pool.largest(gap)
        if piece is None:
            piece, rest = cut(pool.smallest(), gap)
            pool.put(rest)
        out.append(piece)
        gap -= len(piece[2])
    return out


def pack(pool: Pool, tiers: tuple[int, ...], last: bool) -> list[list[tuple]]:
    """Full sequences; without ``last``, what can't fill a window stays in the pool."""
    out = []
    for size, below in zip(tiers, [*tiers[1:], 0]):
        while pool.longest_is_over(below) and pool.total >= size:
            out.append(window(pool, size))
    size = tiers[0]
    while last and pool.total:
        while pool.total >= size:
            out.append(window(pool, size))
        size //= 2
    return out


def step_groups(sizes: list[int], step: int) -> np.ndarray:
    """Group of each sequence: tiers interleaved evenly, then cut into runs of ``step`` ids."""
    s = np.array(sizes)
    place = np.empty(len(s))
    for size in set(sizes):
        own = np.flatnonzero(s == size)
        place[own] = (np.arange(len(own)) + 0.5) / len(own)
    order = np.lexsort((-s, place))
    end = np.cumsum(s[order])
    group = np.empty(len(s), np.int64)
    group[order] = (end - s[order] // 2) // step
    return group


SCHEMA = pa.schema([(c, pa.int64()) for c in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")] + [("ids", pa.binary())])


def packed(docs: DataFrame, vocabulary: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step: int = STEP_IDS,
           keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    context (the sequence's length), step_group, and the ids themselves (little-endian 4-byte) if asked for."""
    source = docs.sparkSession.sparkContext.broadcast(wordbpe.read_vocabulary(vocabulary))
    key = zlib.crc32(source.value)
    schema = SCHEMA if keep_ids else SCHEMA.remove(len(SCHEMA) - 1)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        enc = wordbpe.load(key, lambda: source.value.decode(), MEMO)
        tail = np.array([end_id], enc.dtype)
        pool, whole, count, steps = Pool(), [], 0, 0

        def emit(last):
            nonlocal count, steps, whole
            seqs, whole = whole + pack(pool, tiers, last), []
            if not seqs:
                return
            group = step_groups([sum(len(p[2]) for p in s) for s in seqs], step)
            rows = []
            for s, g in zip(seqs, group.tolist()):
                at, size = 0, sum(len(p[2]) for p in s)
                for doc, start, ids, total in s:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, start, len(ids), zlib.crc32(raw), total, base + count, at, size, base + steps + g, raw))
                    at += len(ids)
                count += 1
            steps += int(group.max()) + 1
            yield batch(schema, **dict(zip(SCHEMA.names, map(list, zip(*rows)))))

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                for doc, ids in zip(p.column(0).to_pylist(), enc.encode(p.column(1).to_pylist())):
                    ids = np.concatenate([ids, tail])
                    n, cutoff = len(ids), len(ids) // tiers[0] * tiers[0]
                    whole += [[(doc, k, ids[k: k + tiers[0]], n)] for k in range(0, cutoff, tiers[0])]
                    held += n
                    if cutoff < n:
                        pool.put((doc, cutoff, ids[cutoff:], n))
                    if held >= POOL_IDS:
                        held = 0
                        yield from emit(False)
        yield from emit(True)

    ddl = ", ".join(f"{f.name} long" for f in SCHEMA if f.name != "ids") + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)
