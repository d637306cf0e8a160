"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from alphaloom.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_print(text):
    w = WORD.findall((text or "").translate(LOW))
    s = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, component) of (doc_id, fingerprint as an int)."""
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    fp = np.array([f for _, f in rows], np.uint64)
    for k, (i, f) in enumerate(rows):
        for j in np.flatnonzero(np.bitwise_count(fp[:k] ^ np.uint64(f)) <= 2).tolist():
            if i is not None and rows[j][0] is not None:
                a, b = sorted((find(i), find(rows[j][0])))
                top[b] = a
    return sorted(((i, f"{f:016x}", None if i is None else find(i)) for i, f in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert result(queries.op11_simhash(spark, sf_dir)) == brute([(r["doc_id"], brute_print(r["text"])) for r in rows])


def test_odd_documents(spark, odd_docs):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in odd_docs.collect()]
    extra = odd_docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("n", F.lit(0))
    assert result(simhash.near_duplicates(extra)) == brute(rows)
    assert simhash.near_duplicates(odd_docs.where("false")).count() == 0


def flipped(rng, f, n):
    for b in rng.sample(range(64), n):
        f ^= 1 << b
    return f


def linked(spark, prints):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(prints))], "fp long").repartition(3)
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    top = {f: f for f in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in got:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {f: find(f) for f in prints}


def brute_links(prints):
    prints = sorted(set(prints))
    return {i: c for i, _, c in brute([(f, f) for f in prints])}


def test_links_of_random_fingerprints(spark, monkeypatch):
    """Every place of one or two flipped bits, clusters around a base, and strangers at three bits."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [flipped(rng, f, n) for f in base for n in (1, 2, 3, 4, 2, 5)] + [0, 1, 3, (1 << 64) - 1, 1 << 63, 7 << 61]
    prints += [base[0] ^ (1 << b) for b in range(0, 64, 3)] + [base[1] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 9) for b in range(a + 1, 64, 7)]
    want = brute_links(prints)
    assert linked(spark, prints) == want
    monkeypatch.setattr(simhash, "BLOCK", 4)        # hot signatures, second parts and pairs of blocks
    assert linked(spark, prints) == want


def test_hot_half(spark, monkeypatch):
    """Many fingerprints with one half in common."""
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = random.Random(6)
    for shift in (0, 32):
        prints = [(0x12345678 << shift) | (rng.getrandbits(32) << (32 - shift)) for _ in range(300)]
        prints += [flipped(rng, f, 2) for f in prints[:60]] + [flipped(rng, f, 1) for f in prints[60:90]]
        assert linked(spark, prints) == brute_links(prints)
