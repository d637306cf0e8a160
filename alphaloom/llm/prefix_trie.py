"""Prefix trie of conversations, by count-min screening of prefix digests.

Conversations are rebuilt so that some begin alike: the first h turns of the conversation whose number is the next lower
multiple of twenty, then the own turns after the first h (h from a checksum of the number).  A node is a distinct sequence
of first d turns; its members are the conversations that begin with it.

* A prefix is known by a digest of two 64-bit lanes, ``sum of item(i) * base**i`` over its turns i, an item being a hash of
  role and text.  Turns are dealt by range of (conversation, turn), so a conversation of any length is spread over tasks:
  each task sums its own run of turns, and the sums of earlier runs are added to it afterwards, shifted by a power of the
  base.  The same shift puts own turns behind borrowed ones.
* All digests are counted in a count-min sketch of bounded size with counters that stop at two.  A prefix with a counter
  of one is in no other conversation: such tails become nodes where they stand.  The others, only possibly shared, are
  shuffled and grouped exactly.
* The smallest member of a node names it.  A conversation that names a node names all its longer prefixes too, so every
  conversation owns one path, from some depth down.  Sums over a subtree are therefore sums over members: its leaves are
  the members whose path ends without children, and its saved tokens are the members' tokens above their own path.  No
  level is walked.
* The digest of the conversations that end at a node is sequential by nature: their numbers are packed in order by range,
  and one task a node hashes the packs as a stream.

Edge cases: rows with a null conv_id are left out; null roles and texts are empty; a null turn comes first; rows with the
same turn stand in order of a hash of role and text, and repeated rows are turns of their own; a conversation without
turns ends at the root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, shuffle_partitions, stored, vacate
from alphaloom.llm.hot import is_hot, lookup
from alphaloom.llm.scan import mix

GROUP = 20                  # conversations that borrow from the same one
BORROWED = 4                # h is below this
COUNTERS = 8                # counters of a row of the sketch for each prefix ..
MAX_WIDTH = 1 << 26         # .. up to this many: beyond it, more prefixes count as possibly shared
SKETCH_ROWS = 3
SLAB = 1 << 16              # counters sent together
PACK = 1 << 16              # bytes of conversation numbers hashed together
_U = np.uint64
_MASK = (1 << 64) - 1
_BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
NODE = ["depth", "a", "b"]


def _local_sums(turns: DataFrame) -> DataFrame:
    """Runs of a conversation's turns within a task: number, both sums and words up to each turn, and before it."""
    schema = pa.schema([(c, pa.int64()) for c in ("conv", "pid", "n", "a", "b", "a_before", "b_before", "w", "words")])

    def run(batches):
        pid = TaskContext.get().partitionId()
        last, seen, carry, words = None, 0, [0, 0], 0
        for t in batches:
            if not t.num_rows:
                continue
            conv, w = t.column(0).to_numpy(), t.column(3).to_numpy()
            k = np.arange(len(conv))
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, k, 0))
            going = (start == 0) & (not new[0])         # the conversation that the last batch ended in
            n = k - start + 1 + np.where(going, seen, 0)
            total = np.cumsum(w)
            upto = total - (total - w)[start] + np.where(going, words, 0)
            lanes = []
            for lane, base in enumerate(_BASES):
                power = np.cumprod(np.full(len(conv), base, np.uint64))[k - start]
                power[going] *= _U(pow(base, seen, 1 << 64))
                term = t.column(1 + lane).to_numpy().view(np.uint64) * power
                s = np.cumsum(term)
                s = s - (s - term)[start]
                s[going] += _U(carry[lane])
                lanes += [s, s - term]
            last, seen, words, carry = conv[-1], int(n[-1]), int(upto[-1]), [int(lanes[0][-1]), int(lanes[2][-1])]
            a, a0, b, b0 = (pa.array(x.view(np.int64)) for x in lanes)
            yield batch(schema, conv=t.column(0), pid=np.full(len(conv), pid), n=n, a=a, b=b, a_before=a0, b_before=b0, w=t.column(3), words=upto)

    return turns.mapInArrow(run, "conv long, pid long, n long, a long, b long, a_before long, b_before long, w long, words long")


def _whole_sums(runs: DataFrame) -> DataFrame:
    """The same over whole conversations.  At most two conversations of a task go on in another one."""
    split = runs.groupBy("conv").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("lo < hi").select("conv")
    ends = runs.join(split, "conv").groupBy("conv", "pid").agg(F.max(F.struct("n", "a", "b", "words")).alias("m"))
    before, last = {}, None
    for r in sorted(ends.select("conv", "pid", "m.*").collect()):
        if r["conv"] != last:
            last, so_far = r["conv"], (0, 0, 0, 0)
        before[r["conv"], r["pid"]] = so_far
        n, a, b, w = so_far
        shift = [pow(base, n, 1 << 64) for base in _BASES]
        so_far = (n + r["n"], (a + shift[0] * (r["a"] & _MASK)) & _MASK, (b + shift[1] * (r["b"] & _MASK)) & _MASK, w + r["words"])
    known = runs.sparkSession.sparkContext.broadcast(before)
    schema = pa.schema([(c, pa.int64()) for c in ("conv", "n", "a", "b", "a_before", "b_before", "w", "words")])

    def run(batches):
        by_task = {}
        for (conv, pid), what in known.value.items():
            by_task.setdefault(pid, []).append((conv, what))
        for t in batches:
            cols = {c: t.column(c).to_numpy().copy() for c in t.schema.names}
            for pid in np.unique(cols["pid"]).tolist():
                for conv, (n, a, b, w) in by_task.get(pid, ()):
                    own = np.flatnonzero((cols["conv"] == conv) & (cols["pid"] == pid))
                    if n and len(own):
                        for lane, add in zip("ab", (a, b)):
                            shift = _U(pow(_BASES["ab".index(lane)], n, 1 << 64))
                            for c in (lane, f"{lane}_before"):
                                cols[c][own] = (cols[c][own].view(np.uint64) * shift + _U(add)).view(np.int64)
                        cols["n"][own] += n
                        cols["words"][own] += w
            yield batch(schema, **{c: pa.array(cols[c]) for c in schema.names})

    return runs.mapInArrow(run, "conv long, n long, a long, b long, a_before long, b_before long, w long, words long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, convs): a row for each conversation and depth, and one for each conversation with its depth and tokens.

    Prefixes: conv, depth, digest (a, b), digest one turn before (a_before, b_before), w (words of the last turn), pre
    (words before it), ends (whether the conversation ends here).
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.xxhash64(F.lit(1), role, text).alias("ia"), F.xxhash64(F.lit(2), role, text).alias("ib"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"), F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "ia", "ib", "row"]
    runs = stored(_local_sums(turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)), "runs")
    rows = stored(_whole_sums(runs), "turns")

    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(BORROWED)).cast("int")
    head = F.array_sort(F.collect_list(F.when(F.col("n") < BORROWED, F.struct("n", "a", "b", "a_before", "b_before", "w", "words"))))
    own = stored(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), F.max("words").alias("all_words"), head.alias("head")), "conversations")
    lent = own.where(F.pmod("conv", F.lit(GROUP)) == 0).select(F.col("conv").alias("lender"), F.col("head").alias("lent"))
    convs = own.withColumn("h", h).withColumn("lender", F.expr(f"conv - pmod(conv, {GROUP})")).join(lent, "lender", "left")
    convs = convs.withColumn("lent", F.expr("slice(coalesce(lent, slice(head, 1, 0)), 1, h)")).withColumn("m", F.size("lent").cast("long"))
    at = [F.coalesce(F.try_element_at("lent", F.lit(-1))[c], F.lit(0)).alias(f"lent_{c}") for c in ("a", "b", "words")]
    cut = F.expr("slice(head, 1, h)")
    at += [F.coalesce(F.try_element_at(cut, F.lit(-1))[c], F.lit(0)).alias(f"cut_{c}") for c in ("a", "b", "words")]
    convs = convs.select("conv", "h", "m", "turns", "lent", "all_words", *at)
    convs = convs.withColumn("depth", F.col("m") + F.greatest(F.lit(0), F.col("turns") - F.col("h")))
    convs = stored(convs.withColumn("tokens", F.col("lent_words") + F.col("all_words") - F.col("cut_words")), "rebuilt")

    borrowed = convs.select("conv", F.col("depth").alias("whole"), F.explode("lent").alias("t")).select(
        "conv", F.col("t.n").alias("depth"), "t.a", "t.b", "t.a_before", "t.b_before", "t.w", (F.col("t.words") - F.col("t.w")).alias("pre"), (F.col("t.n") == F.col("whole")).alias("ends"))
    total = rows.count()
    needed = convs.select("conv", "h", "m", "depth", "turns", *[f"{x}_{c}" for x in ("lent", "cut") for c in ("a", "b", "words")])
    after = lookup(rows, needed, ["conv"], is_hot("turns", total)).where("n > h")
    prefixes = stored(borrowed.unionByName(_moved(after)), "prefixes")
    return prefixes, convs.select("conv", "depth", "tokens")


def _moved(after: DataFrame) -> DataFrame:
    """Own turns behind the borrowed ones: cut sums are taken off, the rest is shifted and added to the lent sums."""
    schema = pa.schema([*((c, pa.int64()) for c in ("conv", "depth", "a", "b", "a_before", "b_before", "w", "pre")), ("ends", pa.bool_())])
    inverse = [np.array([pow(base, -k, 1 << 64) for k in range(BORROWED)], np.uint64) for base in _BASES]

    def run(batches):
        vacate()
        for t in batches:
            c = {f: t.column(f).to_numpy() for f in t.schema.names}
            depth, out = c["m"] + c["n"] - c["h"], {}
            for lane, inv in zip("ab", inverse):
                shift = inv[c["h"] - c["m"]]
                for f in (lane, f"{lane}_before"):
                    moved = (c[f].view(np.uint64) - c[f"cut_{lane}"].view(np.uint64)) * shift + c[f"lent_{lane}"].view(np.uint64)
                    out[f] = pa.array(moved.view(np.int64))
            yield batch(schema, conv=t.column("conv"), depth=depth, w=t.column("w"), pre=c["lent_words"] + c["words"] - c["cut_words"] - c["w"], ends=pa.array(depth == c["depth"]), **out)

    return after.mapInArrow(run, "conv long, depth long, a long, b long, a_before long, b_before long, w long, pre long, ends boolean")


def _places(a: np.ndarray, b: np.ndarray, width: int):
    """Counter of each prefix in each row of the sketch."""
    for k in range(SKETCH_ROWS):
        yield k, (mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + _U(k + 1))) & _U(width - 1)).astype(np.int64)


def _sketch(prefixes: DataFrame, width: int) -> list[np.ndarray]:
    """For each row of the sketch, bits of the counters that are above one."""
    slab = min(SLAB, width)
    schema = pa.schema([("place", pa.int64()), ("data", pa.binary())])

    def count(batches):
        vacate()
        rows = [np.zeros(width, np.uint8) for _ in range(SKETCH_ROWS)]
        for t in batches:
            for k, at in _places(t.column(0).to_numpy(), t.column(1).to_numpy(), width):
                at, n = np.unique(at, return_counts=True)
                rows[k][at] = np.minimum(2, rows[k][at] + n)
        for k, row in enumerate(rows):
            for s in np.flatnonzero(row.reshape(-1, slab).any(axis=1)).tolist():
                yield batch(schema, place=[k * (width // slab) + s], data=[zlib.compress(row[s * slab: (s + 1) * slab].tobytes(), 1)])

    def merge(batches):
        def done():
            return batch(schema, place=[now], data=[np.packbits(held > 1).tobytes()])
        now, held = None, None
        for t in batches:
            for place, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                if place != now:
                    if now is not None:
                        yield done()
                    now, held = place, np.zeros(slab, np.uint8)
                held = np.minimum(2, held + np.frombuffer(zlib.decompress(data), np.uint8))
        if now is not None:
            yield done()

    parts = prefixes.select("a", "b").mapInArrow(count, "place long, data binary").repartition(shuffle_partitions(prefixes.sparkSession), "place")
    bits = np.zeros((SKETCH_ROWS * (width // slab), slab // 8), np.uint8)
    for place, data in parts.sortWithinPartitions("place").mapInArrow(merge, "place long, data binary").collect():     # at most SKETCH_ROWS * MAX_WIDTH bits
        bits[place] = np.frombuffer(data, np.uint8)
    return list(bits.reshape(SKETCH_ROWS, -1))


SHARED, TOP, TAIL = 0, 1, 2         # possibly shared; proven single below a possibly shared prefix; single below a single one


def _screened(prefixes: DataFrame) -> DataFrame:
    """Prefixes by kind."""
    n = prefixes.count()
    width = min(MAX_WIDTH, 1 << max(16, (COUNTERS * max(n, 1) - 1).bit_length()))
    known = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, width))

    def run(batches):
        vacate()
        bits = known.value

        def single(a, b):
            out = np.zeros(len(a), bool)
            for k, at in _places(a, b, width):
                out |= (bits[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
            return out
        for t in batches:
            c = [t.column(f).to_numpy() for f in ("a", "b", "a_before", "b_before", "depth")]
            below = single(c[2], c[3]) & (c[4] > 1)
            kind = np.where(~single(c[0], c[1]), SHARED, np.where(below, TAIL, TOP)).astype(np.int32)
            yield t.append_column("kind", pa.array(kind))

    schema = ", ".join(f"{c} {t}" for c, t in prefixes.dtypes)
    return stored(prefixes.mapInArrow(run, f"{schema}, kind int"), "screened", by="kind")


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending conversation numbers at each node (depth, a, b, conv)."""
    packs = pa.schema([(c, pa.int64()) for c in (*NODE, "first")] + [("data", pa.binary())])
    hashes = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
    parts, order = shuffle_partitions(ends.sparkSession), [*NODE, "conv"]

    def pack(batches):
        now, first, held, size = None, 0, [], 0
        for t in batches:
            for *node, conv in zip(*(t.column(k).to_pylist() for k in range(4))):
                if node != now or size > PACK:
                    if held:
                        yield batch(packs, **{c: [v] for c, v in zip(NODE, now)}, first=[first], data=[",".join(held).encode()])
                    now, first, held, size = node, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield batch(packs, **{c: [v] for c, v in zip(NODE, now)}, first=[first], data=[",".join(held).encode()])

    def digest(batches):
        now, h = None, None
        for t in batches:
            for *node, data in zip(*(t.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if node != now:
                    if h:
                        yield batch(hashes, **{c: [v] for c, v in zip(NODE, now)}, ends_sha256=[h.hexdigest()])
                    now, h = node, hashlib.sha256(data)
                else:
                    h.update(b"," + data)
        if h:
            yield batch(hashes, **{c: [v] for c, v in zip(NODE, now)}, ends_sha256=[h.hexdigest()])

    packed = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, a long, b long, first long, data binary")
    return packed.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes, convs = rebuilt(conversations)
    screened = _screened(prefixes)
    shared, tops, tails = (screened.where(F.col("kind") == k).drop("kind") for k in (SHARED, TOP, TAIL))
    one, up = F.lit(1).cast("long"), [(F.col("depth") - 1).alias("depth"), F.col("a_before").alias("a"), F.col("b_before").alias("b")]

    nodes = stored(shared.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("pre").alias("pre"),
                                             F.min("a_before").alias("a_before"), F.min("b_before").alias("b_before")), "nodes")
    below = stored(nodes.select(*up).unionByName(tops.select(*up)).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")), "children")
    nodes = stored(nodes.join(below, NODE, "left").fillna(0, ["n_children"]), "nodes")

    # a conversation's tokens above its own path, and whether its path ends in a leaf
    none = F.lit(None).cast("struct<depth: bigint, pre: bigint>")
    facts = convs.select("conv", F.col("tokens"), none.alias("path"), F.lit(0).alias("leaf"))
    facts = facts.unionByName(nodes.select(F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("tokens"), F.struct("depth", "pre").alias("path"), (F.col("n_children") == 0).cast("int").alias("leaf")))
    facts = facts.unionByName(tops.select("conv", F.lit(0).cast("long").alias("tokens"), F.struct("depth", "pre").alias("path"), F.lit(0).alias("leaf")))
    facts = facts.unionByName(tops.unionByName(tails).where("ends").select("conv", F.lit(0).cast("long").alias("tokens"), none.alias("path"), F.lit(1).alias("leaf")))
    own = facts.groupBy("conv").agg(F.coalesce(F.min("path")["pre"], F.max("tokens")).alias("above"), F.max("leaf").cast("long").alias("leaf"))
    own = stored(own, "paths")

    sums = [F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("above") - F.col("pre"))).alias("saved_tokens")]
    subtree = shared.join(own, "conv").groupBy(*NODE).agg(*sums)
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    ends = stored(_ends(shared.where("ends").select(*NODE, "conv").unionByName(convs.where("depth = 0").select(*zero, "conv"))), "ends")
    empty = F.lit(hashlib.sha256(b"").hexdigest())

    root = own.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("leaves"), F.sum("above").alias("saved_tokens")).where("n_convs > 0")
    root = root.select(*zero, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "leaves", "saved_tokens")
    root = root.join(below, NODE, "left").fillna(0, ["n_children"])
    root = root.withColumn("n_leaves", F.greatest(F.col("leaves"), (F.col("n_children") == 0).cast("long")))        # a bare root is a leaf
    first = F.broadcast(convs.agg(F.min("conv").alias("root_conv")))            # one row

    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"), "n_children")
    rows = parents.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    parents = parents.withColumn("hot", is_hot("n_children", rows)).drop("n_children")

    def with_parent(df):
        """A node below no grouped one stands below a single prefix of its own conversation."""
        key = df.withColumns({"own_a": F.col("a"), "own_b": F.col("b"), "a": F.col("a_before"), "b": F.col("b_before"), "depth": F.col("depth") - 1})
        deep = lookup(key.where("depth > 0"), parents, NODE, F.col("hot"), "left").drop("hot")
        top = key.where("depth = 0").join(first).withColumnRenamed("root_conv", "parent_conv_id")
        out = deep.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")).unionByName(top)
        return out.withColumns({"a": F.col("own_a"), "b": F.col("own_b"), "depth": F.col("depth") + 1})

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = with_parent(nodes).join(subtree, NODE).unionByName(root.withColumns({c: F.lit(None).cast("long") for c in ("pre", "a_before", "b_before", "own_a", "own_b")}).drop("leaves"))
    grouped = grouped.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(*out)
    lone = with_parent(tops.withColumn("conv_id", F.col("conv"))).select("conv_id", "depth", "parent_conv_id", "ends")
    lone = lone.unionByName(tails.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), "ends"))
    lone = lone.withColumns({"n_convs": one, "n_children": (~F.col("ends")).cast("long"), "n_leaves": one, "saved_tokens": F.lit(0).cast("long"),
                             "ends_sha256": F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty)})
    return grouped.unionByName(lone.select(*out))
