"""Phrase collocations against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from alphaloom.llm import collocations, queries

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CUT, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def brute(rows, least=100, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in CUT.split((text or "").translate(LOW)):
            w = WORD.findall(piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f[lang][tuple(w[i: i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i: i + k]] = max(inside[p[i: i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * inside[p] < 100 * a:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def given(sf_dir):
    return [(r["lang"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["lang", "text"]).to_pylist()]


def test_documents(spark, sf_dir):
    got = result(queries.op13_collocations(spark, sf_dir))
    assert got == brute(given(sf_dir)) and got


@pytest.mark.parametrize("flush", [1 << 20, 500])
def test_low_threshold(spark, sf_dir, monkeypatch, flush):
    """Many candidates, and beginnings dealt by three and more words."""
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "SHARE", 200)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(collocations.collocations(docs.repartition(6), 5, 300)) == brute(given(sf_dir), 5, 300)


def test_odd_documents(spark, odd_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()] + [("und", "x y z x y z. X Y"), (None, "x y\x85z   x  y\x0bz"), ("fr", "a a a a a a a a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, word string")
    for least in (1, 2, 3):
        assert result(collocations.collocations(df, least)) == brute(rows, least)
    assert collocations.collocations(df.where("false")).count() == 0


def test_quicksort():
    rng = np.random.default_rng(3)
    s = rng.integers(1, 6, (3000, 5)).astype(np.int32)
    for k, end in enumerate(rng.integers(1, 6, 3000)):
        s[k, end:] = 0
    counts = rng.integers(1, 4, 3000)
    want = Counter()
    for row, n in zip(s.tolist(), counts.tolist()):
        for k in range(2, 6):
            if row[k - 1]:
                want[tuple(row[:k])] += n
    got = {tuple(s[p, :k].tolist()): n for p, k, n, whole in collocations.multikey_quicksort(np.ascontiguousarray(s.T), counts, np.full(3000, 2, np.int8), 40) if whole}
    assert got == {p: n for p, n in want.items() if n >= 40}
