"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; a bit is set where more than half of a text's three-word shingles have it set in their XXH64.
Fingerprints that differ in at most two bits are linked.

Cut into two halves of 32 bits, such a pair differs by at most one bit in one of them.  So each distinct fingerprint is
indexed under 64 signatures: a half, the place of one deleted bit, and the other 31 bits.  Two halves that differ in one
bit agree on the signature that deletes it, equal halves on all; an equality join on signatures misses no pair, and all
bits of those that meet are compared.

A signature held by more than ``BLOCK`` fingerprints is cut again: of the 32 bits of the other half, at most two differ,
so one of its two quarters differs by at most one bit, and its 32 deletion variants are the second part of the key.  What
agrees on both parts has at most 18 free bits; groups that are still large are compared in pairs of blocks.  A comparison
yields edges that span what it links, never all pairs.

Copies count once: all is done on distinct fingerprints, and documents join their fingerprint's component at the end.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; fewer than
three words are one shingle; rows with the same doc_id share a component and keep fingerprints of their own; a null doc_id
has the null component and links nothing; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, shuffle_partitions, stored, vacate
from alphaloom.llm.components import components
from alphaloom.llm.hot import is_hot, lookup

WORDS = 3
SEED = 42
MOST_APART = 2
BLOCK = 1024                # fingerprints of a group on each side of a comparison
GATHER = 1 << 15            # rows compared in one go


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, A-Z lowered, words joined by one space."""
    import xxhash

    found = text.lower().split()        # bytes: ASCII letters and the blanks \x20 \x09-\x0D only
    if not found:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(found), list(accumulate((len(w) + 1 for w in found)))
    starts, k = [0, *ends[:-1]], min(words, len(found))
    return np.fromiter((xxhash.xxh64_intdigest(line[a: z - 1], SEED) for a, z in zip(starts, ends[k - 1:])), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at: at + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (``fp``, signed) of every row."""
    def run(batches):
        vacate()
        for b in batches:
            found = [fingerprint(shingle_hashes(t.as_py() or b"", words)) for t in b.column(1).cast(pa.binary())]
            yield batch(PRINT, doc_id=b.column(0), fp=found)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(of: str, bits: int) -> str:
    """SQL of the deletion variant numbered ``v`` (0 to 2 * bits - 1) of a value of two parts of ``bits`` bits each."""
    part = f"(shiftrightunsigned({of}, cast(v div {bits} as int) * {bits}) & {(1 << bits) - 1}L)"
    return f"shiftleft(v, {bits}) | ({part} & ~shiftleft(1L, cast(v % {bits} as int)))"


def _numbered(df: DataFrame, n: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n_v")).withColumn("v", F.col("n_v").cast("long")).drop("n_v")


def signatures(prints: DataFrame) -> DataFrame:
    """(key, fp): the 64 deletion variants of every fingerprint."""
    return _numbered(prints.select("fp"), 64).select(F.expr(_variants("fp", 32)).alias("key"), "fp")


def _second(hot: DataFrame) -> DataFrame:
    """(key, sub, fp): deletion variants of the quarters of the half that the key doesn't cover."""
    other = hot.withColumn("rest", F.expr("shiftrightunsigned(fp, cast(32 - shiftrightunsigned(key, 37) * 32 as int)) & 4294967295L"))
    return _numbered(other, 32).select("key", F.expr(_variants("rest", 16)).alias("sub"), "fp")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(representative, member) edges that join what the pairs x, y of n things join."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[x], low[y])
        after = low.copy()
        for side in (x, y):
            np.minimum.at(after, low[side], least)
            np.minimum.at(after, side, least)
        after = after[after]
        if (after == low).all():
            out = np.flatnonzero(low != np.arange(n))
            return low[out], out
        low = after


def _compared(rows: DataFrame) -> DataFrame:
    """Edges that span the links within each group (key, sub, i, j)."""
    def edges(code, fp, side, cross):
        hit_x, hit_y = [], []
        at, k = np.arange(len(code)), 1
        while len(at := at[at + k < len(code)]) and len(at := at[code[at] == code[at + k]]):
            y = at + k
            near = (np.bitwise_count((fp[at] ^ fp[y]).view(np.uint64)) <= MOST_APART) & ~(cross[at] & (side[at] == side[y]))
            hit_x.append(at[near])
            hit_y.append(y[near])
            k += 1
        if hit_x:
            a, b = _spanning(np.concatenate(hit_x), np.concatenate(hit_y), len(code))
            pairs = np.unique(np.stack([fp[a], fp[b]]), axis=1)
            yield batch(PAIR, a=pa.array(pairs[0]), b=pa.array(pairs[1]))

    def run(batches):
        vacate()
        held, size, last, code = [], 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy() for c in range(4)]
            new = np.concatenate([[last != tuple(c[0] for c in key)], np.any([c[1:] != c[:-1] for c in key], axis=0)])
            last, codes = tuple(c[-1] for c in key), code + np.cumsum(new)
            code = int(codes[-1])
            held.append([codes, b.column(4).to_numpy(), b.column(5).to_numpy(), key[2] != key[3]])
            size += b.num_rows
            if size >= GATHER:          # all groups but the last one are whole
                cols = [np.concatenate(c) for c in zip(*held)]
                end = int(np.searchsorted(cols[0], code))
                yield from edges(*(c[:end] for c in cols))
                held, size = [[c[end:] for c in cols]], len(cols[0]) - end
        if size:
            yield from edges(*(np.concatenate(c) for c in zip(*held)))

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "sub", "i", "j").sortWithinPartitions("key", "sub", "i", "j")
    return dealt.select("key", "sub", "i", "j", "fp", "block").mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that span all links between distinct fingerprints (``fp``)."""
    # one exchange: most signatures have one holder and end here
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    held = stored(signatures(prints).withColumn("n", size).where("n > 1"), "holders")
    hot = stored(_second(held.where(F.col("n") > BLOCK)), "hot-holders")
    dense = hot.groupBy("key", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    once = held.where(F.col("n") <= BLOCK).select("key", F.lit(-1).cast("long").alias("sub"), "fp", F.lit(1).alias("blocks"))
    rows = once.unionByName(hot.join(dense, ["key", "sub"]))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _compared(rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = stored(fingerprints(docs, words), "prints")
    named = prints.where("doc_id is not null")
    classes = stored(named.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    # rows of one doc_id belong together
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("doc_id", "a")
    several = named.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    joined = components(links(classes).unionAll(several)).withColumnRenamed("node", "fp")
    of = classes.join(joined, "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    of = stored(of, "members")
    tops = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named_class = stored(of.join(tops, "component").select("fp", "n", "component_id"), "components")
    out = lookup(named, named_class, ["fp"], is_hot("n", named.count())).drop("n")
    out = out.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
