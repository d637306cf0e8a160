"""Exact n-gram Jaccard join of documents by parity sketches.

A document is the set of its distinct five-word shingles, as 64-bit hashes; the sketch of a set deals the hashes to P cells
by their high bits and XORs those of a cell.  Two sets differ in at most as many cells as their symmetric difference has
elements, so the number of differing cells bounds it from below.  At similarity 0.75 the difference of sets of a and b
elements is at most (a + b) / 7.  P is fixed for each band of sizes so that a set fills more cells than that: by the
pigeonhole principle a similar pair has a filled cell in common (a set that fills too few cells also offers its empty
ones).  Sets near the end of their band offer the cells of the next band's sketch too.

1. A first pass counts cells by hash in a table of fixed size.  The counts give all cells one global order, the rarest
   first; a set that fills more cells than it may differ in offers only so many and one, the first in that order.  Of two
   similar sets the first common cell has at most so many others before it in either, so both offer it, and cells that
   strangers share are not offered.  The counts decide the order only: any order is exact.
   A second pass makes the cells.  Cells are joined by value in packed numpy blocks, by 40 bits within their part of the
   keys: cells that agree by chance only cost a comparison.  Within a task, copies of a set offer theirs once, and the
   holders of a cell are one set of holders with a name.  Cells with the same holders say the same, so from here on a set
   of holders stands for all its cells: rows grow with the sets of documents that meet, not with the cells in which they do.
2. Each document is verified against the partner with which it shares most cells, copies are linked by a 192-bit
   fingerprint of the set, and the links' components are built.
3. In sets of holders that lie in several components, pairs across components are filtered by size and by the Hamming
   distance of parity-bit sketches, in blocks of bounded size.  What they allow to be linked is one cluster; the texts of
   a cluster meet once (in pairs of blocks if it is large), and whole sets are compared across components.  Both steps
   yield edges that span what they join, not pairs: rows grow with the documents of a group, not with its square.  Pairs
   within a component can't change it; no other pair is left out, and none is sampled.

Verification counts the common hashes of the two whole sets.

Edge cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text with
fewer than five words is one shingle; rows with the same doc_id share a component and keep their own shingle counts; a
null doc_id has the null component; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import scan
from alphaloom.llm.common import batch, shuffle_partitions, stored, vacate
from alphaloom.llm.components import components

WORDS = 5
FLUSH = 1 << 19             # cells held by a task before they are sent
COUNT_BITS = 22             # bits of a cell's hash by which cells are counted
SLAB = 1 << 16              # counts sent together
BLOCK = 1024                # documents of a cell or cluster on each side of a comparison
BLOCK_SHINGLES = 500_000    # shingles of a cluster, likewise
_U = np.uint64
_EMPTY = _U(0x5851F42D4C957F2D)


def _band_edges() -> np.ndarray:
    e = [1]
    while e[-1] < 1 << 40:
        e.append(max(e[-1] + 1, -(-e[-1] * 3 // 2)))
    return np.array(e, np.int64)


EDGES = _band_edges()


def cells_of(band: int) -> int:
    """Cells of a band's sketch: 0.34 for each element of its largest sets, and three."""
    return int(EDGES[band + 1] * 34 // 100) + 3


def most_different(size: int, band: int) -> int:
    """Largest symmetric difference between a set of ``size`` elements and a similar one of at most the band's size."""
    other = min(int(EDGES[band + 1]) - 1, size * 4 // 3)
    return (size + other) // 7


def bands_of(size: int) -> list[int]:
    band = int(np.searchsorted(EDGES, size, "right")) - 1
    return [band, band + 1] if 4 * size >= 3 * int(EDGES[band + 1]) else [band]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(64 - COUNT_BITS)).astype(np.int64)


def cell_keys(s: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Keys of the cells that a set (sorted distinct hashes) offers, over its bands; all filled cells without ``counts``."""
    out = []
    for band in bands_of(len(s)):
        p = cells_of(band)
        cell = ((s >> _U(32)) * _U(p)) >> _U(32)
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        value = np.bitwise_xor.reduceat(s, edge)
        filled = cell[edge]
        salt = _U((band + 1) << 40)
        keys, most = scan.mix(value ^ scan.mix(filled + salt)), most_different(len(s), band)
        if counts is not None and len(edge) > most + 1:
            keys = keys[np.lexsort((keys, counts[_bucket(keys)]))[: most + 1]]
        out.append(keys)
        if len(edge) <= most:
            none = np.ones(p, bool)
            none[filled.astype(np.int64)] = False
            out.append(scan.mix(_EMPTY ^ scan.mix(np.flatnonzero(none).astype(np.uint64) + salt)))
    return np.concatenate(out)


def parity_bits(s: np.ndarray) -> bytes:
    """Sketch of a power of two of at least 64 and ``len(s)`` bits: each the parity of the hashes that fall on it."""
    n = max(64, 1 << (max(len(s), 1) - 1).bit_length())
    odd = np.bincount((s & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, n: int) -> np.ndarray:
    """A sketch of fewer words: halves are XORed."""
    while len(sketch) > n:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def shingle_sets(col: pa.Array, words: int = WORDS):
    """Per row the sorted distinct hashes of its shingles."""
    for _, buf, off in scan.pieces(col):
        w = scan.Words(buf, off, lower=True)
        for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            n = z - a
            if n == 0:
                yield np.zeros(0, np.uint64)
            elif n < words:
                yield scan.mix(scan.windows(w.hashes[a:z], n) + _U(n))
            else:
                s = np.sort(scan.windows(w.hashes[a:z], words))
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
DOC = np.dtype([("doc", "<i8"), ("n", "<i8"), ("f0", "<i8"), ("f1", "<i8"), ("bytes", "<i8")])
CELLS, SHARED, ROWS = 0, 1, 2       # kinds of packed rows
LOW = _U(0xFFFFFFFFFF)              # of a cell's key, beside its part
_OF_SET = _U(0x2545F4914F6CDD1D)


def _mark(s: np.ndarray) -> tuple[int, int, int]:
    """Size and fingerprint of a set."""
    return (len(s), int(np.bitwise_xor.reduce(s).view(np.int64)), int(scan.mix(s).sum(dtype=np.uint64).view(np.int64))) if len(s) else (0, 0, 0)


def _cell_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a cell of each bucket, copies counted once a task: 2 ** COUNT_BITS numbers, whatever the input."""
    slabs = pa.schema([("slab", pa.int32()), ("data", pa.binary())])

    def count(batches):
        vacate()
        n, seen = np.zeros(1 << COUNT_BITS, np.uint32), set()
        for b in batches:
            held = []
            for s in shingle_sets(b.column(1), words):
                if len(s) and (mark := _mark(s)) not in seen:
                    seen.add(mark)
                    held.append(_bucket(cell_keys(s)))
            if held:
                at, m = np.unique(np.concatenate(held), return_counts=True)
                n[at] += m.astype(np.uint32)
            if len(seen) > FLUSH:
                seen.clear()
        for k, part in enumerate(n.reshape(-1, SLAB)):
            if part.any():
                yield batch(slabs, slab=[k], data=[pa.compress(part.tobytes(), "zstd", asbytes=True)])

    def add(batches):
        now, total = None, None
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    if now is not None:
                        yield batch(slabs, slab=[now], data=[total.tobytes()])
                    now, total = k, np.zeros(SLAB, np.uint32)
                total = total + np.frombuffer(pa.decompress(data, 4 * SLAB, "zstd", asbytes=True), np.uint32)
        if now is not None:
            yield batch(slabs, slab=[now], data=[total.tobytes()])

    parts = docs.mapInArrow(count, "slab int, data binary").repartition(shuffle_partitions(docs.sparkSession), "slab")
    out = np.zeros(((1 << COUNT_BITS) // SLAB, SLAB), np.uint32)
    for k, data in parts.sortWithinPartitions("slab").mapInArrow(add, "slab int, data binary").collect():
        out[k] = np.frombuffer(data, np.uint32)
    return out.reshape(-1)


def _names(owner: np.ndarray, of_set: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit names of the sets of distinct owners (documents, or sets by name) that begin at ``start``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    member = scan.mix((owner.view(np.uint64) + _EMPTY) ^ np.where(of_set, _OF_SET, _U(0)))
    size = np.diff(np.append(start, len(owner))).astype(np.uint64)
    return scan.mix(np.add.reduceat(member, start) ^ scan.mix(size + _EMPTY))


def _members(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the members of stretches."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _packed(docs: DataFrame, parts: int, words: int) -> DataFrame:
    """CELLS: cells by part of the key space; SHARED: sets of documents that hold a cell in this task; ROWS: the documents."""
    known = docs.sparkSession.sparkContext.broadcast(_cell_counts(docs, words))

    def run(batches):
        vacate()
        counts = known.value
        keys, owner, rows, sketches, room, seen = [], [], [], [], 0, set()

        def flush():
            nonlocal keys, owner, rows, sketches, room
            out = []
            spread = rows[0][0] % parts if rows else 0
            if keys:
                k, d = np.concatenate(keys), np.concatenate(owner)
                part = (((k >> _U(32)) * _U(parts)) >> _U(32))
                k = (part << _U(40)) | (k & LOW)
                order = np.lexsort((d, k))
                k, d = k[order], d[order]
                once = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
                k, d = k[once], d[once]
                start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                size = np.diff(np.append(start, len(k)))
                k, own, several = k[start], d[start], size > 1
                if several.any():       # these holders stand behind the name of their set
                    name = _names(d, np.zeros(len(d), bool), start)[several].view(np.int64)
                    own[several] = name
                    name, at, n = np.unique(name, return_index=True, return_counts=True)
                    at, size = start[several][at], size[several][at]
                    out.append((spread, SHARED, len(name).to_bytes(8, "little") + name.tobytes() + size.tobytes() + n.tobytes() + d[_members(at, size)].tobytes()))
                part = (k >> _U(40)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
                for a, z in zip(edge, [*edge[1:], len(k)]):
                    by = np.lexsort((own[a:z], several[a:z]))      # equal owners together: they compress well
                    low = k[a:z][by].view(np.uint8).reshape(-1, 8)[:, :5]
                    single = z - a - int(several[a:z].sum())
                    out.append((int(part[a]), CELLS, single.to_bytes(8, "little") + own[a:z][by].tobytes() + low.tobytes()))
            if rows:
                out.append((spread, ROWS, len(rows).to_bytes(8, "little") + np.array(rows, DOC).tobytes() + b"".join(sketches)))
            keys, owner, rows, sketches, room = [], [], [], [], 0
            if len(seen) > FLUSH:
                seen.clear()
            if out:
                yield batch(PACKED, **dict(zip(PACKED.names, map(list, zip(*out)))))

        for b in batches:
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), words)):
                mark = _mark(s)
                sketch = parity_bits(s)
                rows.append((doc, *mark, len(sketch)))
                sketches.append(sketch)
                room += 16
                if len(s) and mark not in seen:
                    seen.add(mark)
                    keys.append(cell_keys(s, counts))
                    owner.append(np.full(len(keys[-1]), doc, np.int64))
                    room += len(keys[-1])
                if room >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "part int, kind int, payload binary")


LONGS = pa.list_(pa.int64())
FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("docs", LONGS), ("sets", LONGS), ("doc_id", pa.int64()), ("n", pa.int64()),
                   ("f0", pa.int64()), ("f1", pa.int64()), ("sketch", pa.binary())])


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, pa.int64()))


def _found(packed: DataFrame) -> DataFrame:
    """ROWS unpacked, and SHARED rows (key, docs, sets, n): the sets of holders that n cells have in a task or a part.

    A set is named by its key; its members are ``docs`` and those of the sets named in ``sets``, which hold documents only.
    """
    def holders(name, docs, n_docs, sets, n_sets, n):
        none = pa.nulls(len(name), pa.int64())
        return batch(FOUND, kind=pa.array(np.full(len(name), SHARED, np.int32)), key=pa.array(name), docs=_lists(docs, n_docs), sets=_lists(sets, n_sets),
                     doc_id=none, n=pa.array(n), f0=none, f1=none, sketch=pa.nulls(len(name), pa.binary()))

    def unpacked(raw):
        n = int.from_bytes(raw[:8], "little")
        at = 8 + n * DOC.itemsize
        r = np.frombuffer(raw[8:at], DOC)
        ends = (np.cumsum(r["bytes"]) + at).tolist()
        return batch(FOUND, kind=pa.array(np.full(n, ROWS, np.int32)), key=pa.nulls(n, pa.int64()), docs=pa.nulls(n, LONGS), sets=pa.nulls(n, LONGS),
                     **{c: pa.array(np.ascontiguousarray(r[f])) for c, f in (("doc_id", "doc"), ("n", "n"), ("f0", "f0"), ("f1", "f1"))},
                     sketch=[raw[e - b: e] for e, b in zip(ends, r["bytes"].tolist())])

    def of_task(raw):
        m = int.from_bytes(raw[:8], "little")
        name, size, n = np.frombuffer(raw, "<i8", 3 * m, 8).reshape(3, m)
        return holders(name, np.frombuffer(raw, "<i8", offset=8 + 24 * m), size, np.zeros(0, np.int64), np.zeros(m, np.int64), n)

    def of_part(k, own, of_set):
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        multi = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(k) else same
        k, order = k[multi], order[multi]
        own, of_set = own[order], of_set[order]
        order = np.lexsort((own, of_set, k))
        k, own, of_set = k[order], own[order], of_set[order]
        once = np.ones(len(k), bool)
        once[1:] = (k[1:] != k[:-1]) | (own[1:] != own[:-1]) | (of_set[1:] != of_set[:-1])
        k, own, of_set = k[once], own[once], of_set[once]
        start = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        name, at, n = np.unique(np.where(size > 1, _names(own, of_set, start), _U(0)), return_index=True, return_counts=True)
        at, n, name = at[size[at] > 1], n[size[at] > 1], name[size[at] > 1]
        start, size = start[at], size[at]
        for a in range(0, len(at), GATHER):
            p = _members(start[a: a + GATHER], size[a: a + GATHER])
            inner, edge = of_set[p], np.cumsum(size[a: a + GATHER]) - size[a: a + GATHER]
            n_sets = np.add.reduceat(inner.astype(np.int64), edge)
            yield holders(name[a: a + GATHER].view(np.int64), own[p][~inner], size[a: a + GATHER] - n_sets, own[p][inner], n_sets, n[a: a + GATHER])

    def run(batches):
        vacate()
        cells = {}
        for b in batches:
            for part, kind, raw in zip(*(c.to_pylist() for c in b.columns)):
                if kind == ROWS:
                    yield unpacked(raw)
                elif kind == SHARED:
                    yield of_task(raw)
                else:
                    n = (len(raw) - 8) // 13
                    low = np.zeros((n, 8), np.uint8)
                    low[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 8 + 8 * n).reshape(-1, 5)
                    of_set = np.arange(n) >= int.from_bytes(raw[:8], "little")
                    cells.setdefault(part, []).append((low.reshape(-1).view("<u8"), np.frombuffer(raw, "<i8", n, 8), of_set))
        for part in list(cells):
            yield from of_part(*(np.concatenate(c) for c in zip(*cells.pop(part))))

    return packed.mapInArrow(run, "kind int, key long, docs array<long>, sets array<long>, doc_id long, n long, f0 long, f1 long, sketch binary")


def _holders(found: DataFrame) -> DataFrame:
    """(key, doc_id, n): the documents of every set of holders, sets that several tasks or parts have found once."""
    sets = stored(found.where(F.col("kind") == SHARED).groupBy("key", "docs", "sets").agg(F.sum("n").alias("n")), "sets")
    plain = sets.where("size(sets) = 0").select(F.col("key").alias("set"), F.col("docs").alias("members"))
    inner = sets.where("size(sets) > 0").select("key", "n", F.explode("sets").alias("set")).join(plain, "set")
    return sets.select("key", F.explode("docs").alias("doc_id"), "n").unionAll(inner.select("key", F.explode("members").alias("doc_id"), "n"))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _apart(sketch_a: bytes, sketch_b: bytes) -> int:
    """Lower bound of the symmetric difference."""
    x, y = np.frombuffer(sketch_a, np.uint64), np.frombuffer(sketch_b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def _near(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches don't rule out."""
    def run(batches):
        vacate()
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keep = [4 * min(m, n) >= 3 * max(m, n) and 7 * _apart(x, y) <= m + n for m, x, n, y in zip(*cols[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=PAIR).filter(pa.array(keep))

    one = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


PER_LEAD = 512              # documents checked against one copy of a set


def _linked(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar.

    The texts of a's partners come to a, split over several copies of a where they are many, and are read one at a time.
    """
    def run(batches):
        vacate()
        lead, own = None, []
        for b in batches:
            hit = [], []
            for a, part, role, doc, s in zip(*(b.column(k).to_pylist() for k in range(4)), shingle_sets(b.column(4), words)):
                if (a, part) != lead:
                    lead, own = (a, part), []
                if not len(s):      # another text of the doc_id
                    continue
                if role == 0:
                    own.append(s)
                elif any(similar(len(np.intersect1d(s, x, assume_unique=True)), len(s), len(x)) for x in own):
                    hit[0].append(a)
                    hit[1].append(doc)
            yield batch(PAIR, a=hit[0], b=hit[1])

    pairs = stored(pairs, "candidates")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_LEAD).alias("m"))
    member = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), "m").alias("part"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leads = copies.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    wanted = stored(member.unionByName(leads), "wanted")
    texts = docs.join(wanted, "doc_id").select("a", "part", "role", "doc_id", "text")
    dealt = texts.repartition(shuffle_partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(run, "a long, b long").distinct()


class _Joined:
    """Groups of numbered things that grow together; ``label`` names each one's group."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def join(self, x: int, others: np.ndarray) -> np.ndarray:
        """Join x with others; returns those of them that were the first of their group to be joined."""
        own = self.label[x]
        new, at = np.unique(self.label[others], return_index=True)
        fresh = new != own
        if fresh.any():
            self.label[np.isin(self.label, new)] = own
        return others[at[fresh]]


def _sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (.., block, i, j) stand on either side of their pair of blocks."""
    block, i, j = np.array([r[-3] for r in rows]), rows[0][-2], rows[0][-1]
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _grouped(rows_of: DataFrame, key: list[str], columns: list[str], edges) -> DataFrame:
    """Apply ``edges(rows)`` to the rows of each key, of which there are two blocks at most."""
    k = len(key)

    def run(batches):
        vacate()
        now, rows = None, []
        for b in batches:
            for r in zip(*(shingle_sets(b.column(n)) if name == "text" else b.column(n).to_pylist() for n, name in enumerate(columns))):
                if r[:k] != now:
                    if rows:
                        yield from edges(rows)
                    now, rows = r[:k], []
                rows.append(r)
        if rows:
            yield from edges(rows)

    dealt = rows_of.repartition(shuffle_partitions(rows_of.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.select(*columns).mapInArrow(run, "a long, b long").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows (doc_id, blocks, ..) of a key to blocks, and every pair of blocks to a key of its own (i, j)."""
    return (rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks"))


GATHER = 8192               # holders whose cells are compared in one go


def _bits_apart(flat: np.ndarray, start: np.ndarray, words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches of pairs; the longer one of a pair is folded."""
    out = np.empty(len(x), np.int64)
    kind = words[x] * (1 << 32) + words[y]
    for w in np.unique(kind).tolist():
        own = np.flatnonzero(kind == w)
        k = min(w >> 32, w & 0xFFFFFFFF)
        for at in range(0, len(own), max(1, (1 << 18) // max(w >> 32, w & 0xFFFFFFFF))):
            part = own[at: at + max(1, (1 << 18) // max(w >> 32, w & 0xFFFFFFFF))]
            sides = []
            for side, n in ((x[part], w >> 32), (y[part], w & 0xFFFFFFFF)):
                m = flat[start[side][:, None] + np.arange(n)]
                while m.shape[1] > k:
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2:]
                sides.append(m)
            out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def _spanned(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of each one's group, for pairs among n things."""
    low = np.arange(n)
    while len(x):
        m = np.minimum(low[x], low[y])
        before = low.copy()
        for side in (x, y):
            np.minimum.at(low, before[side], m)
            np.minimum.at(low, side, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _near_groups(holders: DataFrame) -> DataFrame:
    """Edges that span the groups of a cell's holders whose sizes and sketches allow links across components.

    As many rows as holders at most, however many pairs there are.  The rows of many cells are compared with those 1, 2,
    3, .. places on in their cell, all at once.
    """
    def edges(rows):
        cols = [np.concatenate(c) for c in zip(*(r[0] for r in rows))]
        code, doc, comp, n, block, i, j = cols
        sketches = [x for r in rows for x in r[1]]
        words = np.array([len(x) // 8 for x in sketches])
        flat, start = np.frombuffer(b"".join(sketches), np.uint64), np.cumsum(words) - words
        hit_x, hit_y = [], []
        at, k = np.arange(len(code)), 1
        while len(at := at[at + k < len(code)]) and len(at := at[code[at] == code[at + k]]):
            x, y = at, at + k
            ok = (comp[x] != comp[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & ((i[x] == j[x]) | (block[x] != block[y]))
            x, y = x[ok], y[ok]
            if len(x):
                near = 7 * _bits_apart(flat, start, words, x, y) <= n[x] + n[y]
                hit_x.append(x[near])
                hit_y.append(y[near])
            k += 1
        if not hit_x:
            return
        low = _spanned(len(code), np.concatenate(hit_x), np.concatenate(hit_y))
        out = np.flatnonzero(low != np.arange(len(low)))
        pairs = np.unique(np.stack([doc[low[out]], doc[out]]), axis=1) if len(out) else np.zeros((2, 0), np.int64)
        yield batch(PAIR, a=pa.array(pairs[0]), b=pa.array(pairs[1]))

    def run(batches):
        vacate()
        held, size, last, code = [], 0, None, 0
        for b in batches:
            key = [b.column(c).to_numpy() for c in range(3)]
            if not b.num_rows:
                continue
            new = np.concatenate([[last != tuple(c[0] for c in key)], np.any([c[1:] != c[:-1] for c in key], axis=0)])
            last = tuple(c[-1] for c in key)
            codes = code + np.cumsum(new)
            code = int(codes[-1])
            data = [codes, *(b.column(c).to_numpy() for c in (3, 4, 5, 7)), key[1], key[2]]
            held.append((data, b.column(6).to_pylist()))
            size += b.num_rows
            # whole cells only: those before the last one seen
            if size >= GATHER:
                cols, sketches = [np.concatenate(c) for c in zip(*(r[0] for r in held))], [x for r in held for x in r[1]]
                end = int(np.searchsorted(cols[0], code))
                for a, z in _runs(cols[0][:end], GATHER):
                    yield from edges([([c[a:z] for c in cols], sketches[a:z])])
                held, size = [([c[end:] for c in cols], sketches[end:])], len(cols[0]) - end
        if size:
            cols, sketches = [np.concatenate(c) for c in zip(*(r[0] for r in held))], [x for r in held for x in r[1]]
            for a, z in _runs(cols[0], GATHER):
                yield from edges([([c[a:z] for c in cols], sketches[a:z])])

    dealt = holders.repartition(shuffle_partitions(holders.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "doc_id", "comp", "n", "sketch", "block").mapInArrow(run, "a long, b long").distinct()


def _runs(code: np.ndarray, size: int):
    """Cut ascending codes into stretches of about ``size``, between different codes."""
    at = 0
    while at < len(code):
        to = min(len(code), at + size)
        to = len(code) if to == len(code) else max(int(np.searchsorted(code, code[to])), int(np.searchsorted(code, code[at], "right")))
        yield at, to
        at = to


def _links_across(members: DataFrame) -> DataFrame:
    """Links that span what whole sets join across components, among the members of a group."""
    def edges(rows):
        rows = [r for r in rows if len(r[5])]       # a repeated doc_id brings all its texts
        left, right = _sides(rows) if rows else ((), ())
        if not len(left) or not len(right):
            return
        doc = np.array([r[3] for r in rows])
        group = _Joined(np.unique(np.array([r[4] for r in rows]), return_inverse=True)[1])
        n = np.array([len(r[5]) for r in rows])
        _, ids = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)
        start = np.cumsum(n) - n
        of_right = np.concatenate([ids[start[k]: start[k] + n[k]] for k in right])
        edge = np.cumsum(n[right]) - n[right]
        mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int32)
        out = [], []
        for x in left.tolist():
            other = group.label[right] != group.label[x]
            if not other.any():
                continue
            own = ids[start[x]: start[x] + n[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[of_right], edge)
            mark[own] = 0
            hit = right[other & (100 * common >= 75 * (n[right] + n[x] - common))]
            for y in group.join(x, hit).tolist():
                out[0].append(doc[x])
                out[1].append(doc[y])
        if out[0]:
            yield batch(PAIR, a=pa.array(out[0], pa.int64()), b=pa.array(out[1], pa.int64()))

    return _grouped(members, ["cluster", "i", "j"], ["cluster", "i", "j", "doc_id", "comp", "text", "block", "i", "j"], edges)


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    packed = _packed(whole, parts, words).repartitionById(parts, F.col("part"))
    found = stored(_found(packed), "cells", by="kind")
    rows = found.where(F.col("kind") == ROWS).select("doc_id", "n", "f0", "f1", "sketch")

    # copies of a set: linked to their first document
    mark = ["n", "f0", "f1"]
    first = stored(rows.where("n > 0").groupBy(*mark).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "copies")
    copies = stored(rows.select("doc_id", *mark).join(first, mark).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "copies")
    # a copy that holds cells holds them for the set's first document, unless its doc_id has other sets too
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min(F.struct(*mark)).alias("lo"), F.max(F.struct(*mark)).alias("hi")).where("lo < hi").select("doc_id")
    stands = stored(copies.join(several, copies["a"] == several["doc_id"], "left_anti"), "stands")
    held = _holders(found).join(stands.select(F.col("a").alias("doc_id"), F.col("b").alias("first")), "doc_id", "left")
    held = stored(held.select("key", F.coalesce("first", "doc_id").alias("doc_id"), "n").groupBy("key", "doc_id").agg(F.max("n").alias("n")), "held")

    # each document against the first holder with which it shares most cells: which one is tried first decides nothing,
    # for all other pairs come in the last step
    lead = held.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("key", "lead")
    shared = held.join(lead, "key").where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.sum("n").alias("n"))
    best = shared.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("lead")).alias("l"))).alias("m")).select((-F.col("m.l")).alias("a"), F.col("doc_id").alias("b"))
    links = _linked(_near(best, rows.select("doc_id", "n", "sketch")), whole, words)
    comps = components(links.unionAll(copies))

    # what is left: pairs across components in sets of holders that lie in several
    label = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    named = stored(held.select("key", "doc_id").join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")), "named")
    mixed = stored(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
                   .where("lo < hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "mixed")
    sketched = rows.where("n > 0").select("doc_id", "n", "sketch").distinct()       # all sets of a repeated doc_id
    near = components(_near_groups(_blocks(named.join(mixed, "key").join(sketched, "doc_id"))))
    near = near.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    near = near.join(label, "doc_id", "left").select("doc_id", "cluster", F.coalesce("comp", "doc_id").alias("comp")).join(sketched.drop("sketch"), "doc_id")
    sizes = near.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = stored(_blocks(near.drop("n").distinct().join(sizes, "cluster")), "members")
    more = _links_across(whole.join(members, "doc_id"))
    ends = more.join(label.withColumnRenamed("doc_id", "a").withColumnRenamed("comp", "c_a"), "a", "left")
    ends = ends.join(label.withColumnRenamed("doc_id", "b").withColumnRenamed("comp", "c_b"), "b", "left")
    merged = components(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))

    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    out = out.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("doc_id", "n_shingles", F.coalesce("component", "comp").alias("component_id"))
    return out.unionAll(nameless.select("doc_id", "text").mapInArrow(_sizes(words), "doc_id long, n_shingles long, component_id long"))


def _sizes(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("component_id", pa.int64())])

    def run(batches):
        vacate()
        for b in batches:
            yield batch(schema, doc_id=b.column(0), n_shingles=[len(s) for s in shingle_sets(b.column(1), words)], component_id=b.column(0))
    return run
