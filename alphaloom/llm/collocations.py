"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, and pieces into words.  Every word begins a suffix: itself and up
to four words after it in its piece.

1. A first pass counts the words of each language, and how many suffixes fall into each of a fixed number of buckets by
   their first two, three, four and five words.
2. Suffixes are dealt to tasks by as many leading words as it takes for the bucket to be small beside a task's share:
   two as a rule, more for hot beginnings.  Equal suffixes of a task travel as one with a count.
3. A task sorts pointers to its suffixes by three-way multikey quicksort, one word deeper in each equal partition, down to
   five words.  The size of an equal partition is the count of its phrase; partitions that are too small are abandoned.
   Only phrases that are shorter than what their beginning was dealt by lie in several tasks: those are counted without
   a threshold and added up.
4. Scores and the test for containment are joins among frequent phrases, in exact decimal arithmetic.

Words travel as 64-bit hashes of language and word; the dictionary shows whether two words have one hash (``ValueError``).

Edge cases: a null text has no words; a null lang is ``und``, together with a lang of that name; ties in score and count
go by phrase in the order of UTF-8 bytes; null doc_ids and repeated rows are counted like others; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, shuffle_partitions, stored, vacate
from alphaloom.llm.scan import LOWER, mix, pieces

LONGEST = 5
LEAST = 100                 # occurrences of a candidate
TOP = 2000
BUCKETS = 1 << 16           # by each number of leading words
SHARE = 4                   # a bucket is small up to one part in so many of a task's share
TASK_SUFFIXES = 1 << 22     # suffixes of a task, at most about
FLUSH = 1 << 20             # suffixes sorted out together before they are sent
NO_LANGUAGE = "und"
_U = np.uint64

# fixed values: bytes that end a piece, and bytes between words
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_POWER = 0xD1342543DE82EF95


def _tokens(buf: np.ndarray, off: np.ndarray):
    """(starts, ends, piece of each word, row of each word) of lowered bytes with row offsets."""
    stop = _BREAK[buf]
    inside = ~(stop | _BLANK[buf])
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    row = np.searchsorted(off, starts, "right") - 1
    return starts, ends, np.cumsum(stop)[starts] if len(starts) else starts, row


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            m = max(n, 1 << 20)
            a, b = np.full(m, _POWER, np.uint64), np.full(m, pow(_POWER, -1, 1 << 64), np.uint64)
            a[0] = b[0] = 1
            cls.up, cls.down = np.cumprod(a), np.cumprod(b)
        return cls.up, cls.down


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes, salted; never zero, which marks the end of a suffix."""
    up, down = _Powers.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] ^ salt)
    h[h == 0] = 1
    return h


def _salt(lang: str) -> np.uint64:
    b = np.frombuffer(lang.encode() + b"\x00", np.uint8)
    return _hashes(b, np.array([0]), np.array([len(b)]), np.zeros(1, np.uint64))[0]


def _suffixes(h: np.ndarray, piece: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(words, LONGEST) hashes from each word on; zero beyond its piece."""
    out = np.zeros((len(h), LONGEST), np.uint64)
    out[:, 0] = h
    for k in range(1, LONGEST):
        same = (piece[k:] == piece[:-k]) & (row[k:] == row[:-k])
        out[:-k, k][same] = h[k:][same]
    return out


def _leading(s: np.ndarray) -> list[np.ndarray]:
    """Hash of the first 2, 3, .. LONGEST words of each suffix."""
    out, h = [], s[:, 0].copy()
    for k in range(1, s.shape[1]):
        h = mix(h ^ (s[:, k] * _U(_POWER)))
        out.append(h)
    return out


def _read(batches):
    """(languages, lowered bytes, words .., suffixes) of runs of rows."""
    salts: dict[str, np.uint64] = {}
    for t in batches:
        if not t.num_rows:
            continue
        lang = t.column(0).dictionary_encode()
        names = [x if x is not None else NO_LANGUAGE for x in lang.dictionary.to_pylist()]
        for n in names:
            salts.setdefault(n, _salt(n))
        salt = np.array([salts[n] for n in names], np.uint64)
        code = lang.indices.to_numpy()
        for at, buf, off in pieces(t.column(1)):
            buf = LOWER[buf]
            starts, ends, piece, row = _tokens(buf, off)
            if len(starts):
                of = code[at + row]
                yield names, of, buf, starts, ends, _suffixes(_hashes(buf, starts, ends, salt[of]), piece, row)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))


WORD, BUCKET = 0, 1


def _counted(texts: DataFrame) -> DataFrame:
    """WORD rows (lang, key: hash, word, n) and BUCKET rows (key: bucket, n), counted in each task."""
    schema = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        vacate()
        words, buckets = {}, np.zeros((LONGEST - 1) * BUCKETS, np.int64)

        def flush():
            rows = [(*v, k, n) for k, (v, n) in words.items()]
            words.clear()
            for at in range(0, len(rows), 1 << 16):
                lang, word, key, n = zip(*rows[at: at + (1 << 16)])
                yield batch(schema, kind=pa.array(np.full(len(n), WORD, np.int32)), lang=list(lang), key=pa.array(np.array(key, np.uint64).view(np.int64)), word=list(word), n=list(n))
        for names, of, buf, starts, ends, s in _read(batches):
            key, at, n = np.unique(s[:, 0], return_index=True, return_counts=True)
            raw = buf.tobytes()
            for k, i, m, lang, a, z in zip(key.tolist(), at.tolist(), n.tolist(), of[at].tolist(), starts[at].tolist(), ends[at].tolist()):
                if k in words:
                    words[k][1] += m
                else:
                    words[k] = [(names[lang], raw[a:z].decode()), m]
            for k, h in enumerate(_leading(s)):
                buckets[k * BUCKETS: (k + 1) * BUCKETS] += np.bincount((h >> _U(48)).astype(np.int64), minlength=BUCKETS)
            if len(words) > FLUSH // 4:
                yield from flush()
        yield from flush()
        for at in range(0, len(buckets), BUCKETS):
            used = np.flatnonzero(buckets[at: at + BUCKETS])
            if len(used):
                none = pa.nulls(len(used), pa.string())
                yield batch(schema, kind=pa.array(np.full(len(used), BUCKET, np.int32)), lang=none, key=used + at, word=none, n=buckets[at: at + BUCKETS][used])

    return texts.mapInArrow(run, "kind int, lang string, key long, word string, n long")


def _depths(s: np.ndarray, sizes: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading words that a suffix is dealt by, their hash)."""
    lead = _leading(s)
    depth, by = np.full(len(s), LONGEST, np.int8), lead[-1].copy()
    for k in range(len(lead) - 2, -1, -1):
        fits = sizes[k][(lead[k] >> _U(48)).astype(np.int64)] <= small
        depth[fits], by[fits] = k + 2, lead[k][fits]
    return depth, by


PACKED = pa.schema([("part", pa.int32()), ("data", pa.binary())])


def _dealt(texts: DataFrame, sizes: np.ndarray, small: int, parts: int) -> DataFrame:
    """Suffixes packed by part: distinct words, counts, depths, and columns of word numbers."""
    known = texts.sparkSession.sparkContext.broadcast(sizes)        # (LONGEST - 1) * BUCKETS counts

    def run(batches):
        vacate()
        held, size = [], 0

        def flush():
            s = np.concatenate(held)
            # no phrase begins with a suffix of one word
            s = s[s[:, 1] != 0]
            if not len(s):
                return
            _, at, n = np.unique(_leading(s)[-1], return_index=True, return_counts=True)
            s = s[at]
            depth, by = _depths(s, known.value, small)
            part = ((by >> _U(32)) * _U(parts)) >> _U(32)
            order = np.lexsort((s[:, 1], s[:, 0], part))
            s, depth, part, n = s[order], depth[order], part[order].astype(np.int64), n[order]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            for a, z in zip(edge, [*edge[1:], len(s)]):
                words, ids = np.unique(s[a:z], return_inverse=True)
                ids = ids.reshape(z - a, LONGEST).astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
                head = np.array([len(words), z - a], np.int64)
                data = b"".join([words.tobytes(), n[a:z].astype(np.uint32).tobytes(), depth[a:z].tobytes(), np.ascontiguousarray(ids.T).tobytes()])
                yield batch(PACKED, part=[int(part[a])], data=[head.tobytes() + pa.compress(data, "zstd", asbytes=True)])
        for *_, s in _read(batches):
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "part int, data binary")


def _unpacked(data: bytes):
    w, n = np.frombuffer(data, np.int64, 2).tolist()
    kind, at = np.dtype(np.uint16 if w < 1 << 16 else np.uint32), 8 * w
    data = pa.decompress(data[16:], at + n * (5 + LONGEST * kind.itemsize), "zstd", asbytes=True)
    words, counts = np.frombuffer(data, np.uint64, w), np.frombuffer(data, np.uint32, n, at)
    return words, counts, np.frombuffer(data, np.int8, n, at + 4 * n), np.frombuffer(data, kind, n * LONGEST, at + 5 * n).reshape(LONGEST, n)


def multikey_quicksort(columns: np.ndarray, counts: np.ndarray, depth: np.ndarray, least: int):
    """Yield (pointer, words, count, whole) of the phrases of two words or more with ``least`` occurrences.

    ``columns[d]`` is the word at depth d of every suffix, zero beyond its end.  Phrases shorter than the depth by which
    one of their suffixes was dealt are yielded at any count, and are not ``whole``.
    """
    todo = [(np.arange(len(counts)), 0)]
    while todo:
        own, d = todo.pop()
        while True:
            if int(counts[own].sum()) < least and not (depth[own] > max(2, d + 1)).any():
                break
            key = columns[d][own]
            some = key[:: max(1, len(key) // 63)]
            pivot = np.partition(some, len(some) // 2)[len(some) // 2]
            less, same = key < pivot, key == pivot
            more = own[~(less | same)]
            if len(more):
                todo.append((more, d))
            if less.any():
                todo.append((own[less], d))
            own = own[same]
            if pivot == 0:
                break
            n = int(counts[own].sum())
            if d:
                whole = not (depth[own] > d + 1).any()
                if n >= least or not whole:
                    yield int(own[0]), d + 1, n, whole
            if d + 1 == len(columns):
                break
            d += 1


FOUND = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64()), ("whole", pa.bool_())])


def _sorted(packed: DataFrame, least: int) -> DataFrame:
    """(words, n, whole) of the phrases of each part."""
    def run(batches):
        vacate()
        packs: dict[int, list] = {}
        for t in batches:
            for part, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                packs.setdefault(part, []).append(data)
        for part in list(packs):
            got = [_unpacked(d) for d in packs.pop(part)]
            words, at = np.unique(np.concatenate([np.zeros(1, np.uint64), *(g[0] for g in got)]), return_inverse=True)
            at, columns = at[1:], []
            ends = np.cumsum([len(g[0]) for g in got]).tolist()
            for d in range(LONGEST):
                columns.append(np.concatenate([at[z - len(g[0]): z][g[3][d]] for g, z in zip(got, ends)]).astype(np.int32))
            columns = np.stack(columns)
            counts, depth = np.concatenate([g[1] for g in got]).astype(np.int64), np.concatenate([g[2] for g in got])
            del got
            rows = []
            for pointer, k, n, whole in multikey_quicksort(columns, counts, depth, least):
                rows.append((words[columns[:k, pointer]].view(np.int64).tolist(), n, whole))
                if len(rows) >= 1 << 14:
                    yield batch(FOUND, **dict(zip(FOUND.names, map(list, zip(*rows)))))
                    rows = []
            if rows:
                yield batch(FOUND, **dict(zip(FOUND.names, map(list, zip(*rows)))))

    return packed.mapInArrow(run, "words array<long>, n long, whole boolean")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, dictionary, totals): words array<long> and count of all phrases of 1 to 5 words with so many occurrences;
    key, lang, word of their words; n of each lang."""
    texts = _texts(docs)
    counted = stored(_counted(texts), "counted", by="kind")
    sizes = np.zeros((LONGEST - 1, BUCKETS), np.int64)
    for r in counted.where(F.col("kind") == BUCKET).groupBy("key").agg(F.sum("n").alias("n")).collect():        # (LONGEST - 1) * BUCKETS rows
        sizes[r["key"] // BUCKETS, r["key"] % BUCKETS] = r["n"]
    words = stored(counted.where(F.col("kind") == WORD).groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "words")
    if words.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count():
        raise ValueError("two words with one hash")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = words.where(F.col("n") >= least)

    total = int(sizes[0].sum())
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // TASK_SUFFIXES))
    small = max(1, total // (parts * SHARE))
    packed = _dealt(texts, sizes, small, parts).repartitionById(parts, F.col("part"))
    found = stored(_sorted(packed, least), "found")
    part = found.where("not whole").groupBy("words").agg(F.sum("n").alias("n"))
    # whole partitions of a phrase that has parts elsewhere do not exist: it is dealt by one depth only
    long = found.where("whole").select("words", "n").unionByName(part).where(F.col("n") >= least)
    phrases = long.unionByName(frequent.select(F.array("key").alias("words"), "n"))
    return stored(phrases, "phrases"), frequent.select("key", "lang", "word"), totals


def _slices(of: str, lengths: str) -> str:
    """SQL of all contiguous parts of an array with lengths in a sequence."""
    return f"flatten(transform({lengths}, k -> transform(sequence(1, size({of}) - k + 1), i -> slice({of}, i, k))))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    phrases, dictionary, totals = frequent_phrases(docs, least)
    candidates = phrases.where("size(words) > 1")
    longer = candidates.where("size(words) > 2").select(F.explode(F.expr(_slices("words", "sequence(2, size(words) - 1)"))).alias("words"), F.col("n").alias("m"))
    longer = longer.groupBy("words").agg(F.max("m").alias("m"))
    kept = candidates.join(longer, "words", "left").where("m is null or 100 * m < 100 * n").select("words", F.col("n").alias("a"))

    first = kept.select("words", "a", F.element_at("words", 1).alias("key")).join(dictionary.select("key", "lang"), "key").join(totals, "lang").drop("key")
    cuts = first.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(phrases.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(phrases.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("(cast(1000 * a as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("lang").alias("lang"))

    spelled = best.select("words", F.posexplode("words").alias("at", "key")).join(dictionary.select("key", "word"), "key")
    spelled = spelled.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("words", F.expr("array_join(w.word, ' ')").alias("phrase"))
    rows = best.join(spelled, "words").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
