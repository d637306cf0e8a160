"""Prefix trie of conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from alphaloom.llm import prefix_trie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """Nodes of (conv_id, turn, role, text); no two turns of a conversation share a number."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in sorted(full.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                children[v[:d - 1]].add(v[:d])
        ends[v].append(c)
    out = []
    total = {}
    for v in sorted(members, key=len, reverse=True):
        leaves = sum(total[k][0] for k in children[v]) if children[v] else 1
        saved = (len(members[v]) - 1) * len(WORD.findall(v[-1][1])) if v else 0
        total[v] = leaves, saved + sum(total[k][1] for k in children[v])
        text = ",".join(map(str, ends.get(v, [])))
        out.append((members[v][0], len(v), members[v[:-1]][0] if v else None, len(members[v]), len(children[v]), *total[v], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_conversations(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    assert result(queries.op12_prefix_trie(spark, sf_dir)) == brute(rows)


def made(seed, n, deep=0):
    """Few different texts, so that long prefixes are shared; gaps, short and missing lenders, nulls."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, 400), n):
        length = rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(length):
            rows.append((c, t if t or rng.random() < .8 else None, rng.choice(["user", "user", None]), rng.choice(["a b", "a  b\tc", "", None, "ü — x"])))
    for t in range(deep):
        rows += [(1000, t, "user", f"deep {t}"), (1020, t, "user", f"deep {t}")]
    return rows


@pytest.mark.parametrize("narrow", [False, True])
def test_odd_conversations(spark, monkeypatch, narrow):
    if narrow:      # many prefixes are possibly shared by chance, and packs are cut
        monkeypatch.setattr(prefix_trie, "MAX_WIDTH", 64)
        monkeypatch.setattr(prefix_trie, "PACK", 4)
    rows = made(1, 260, deep=90) + [(None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(5)
    assert result(prefix_trie.trie(df)) == brute(rows)


def test_equal_turns_and_bare_roots(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(c, 0, "user", "x") for c in (1, 2, 3, 21)], [(20, 0, None, None)], [(5, 0, "user", "x y")]):
        assert result(prefix_trie.trie(spark.createDataFrame(rows, schema))) == brute(rows)
    ties = [(40, None, "user", "x"), (40, None, "user", "x"), (40, None, "assistant", "y"), (40, None, "user", "z")]
    got = prefix_trie.trie(spark.createDataFrame(ties, schema)).collect()
    assert sorted(r["depth"] for r in got) == [0, 1, 2, 3, 4] and {r["n_convs"] for r in got} == {1}
