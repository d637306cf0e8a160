"""Line dedup, Jaccard join, quality rules and languages against brute force."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from alphaloom.llm import fertility, jaccard, langid, line_dedup, queries, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return {r["doc_id"]: r["text"] for r in t}, {r["doc_id"]: r["lang"] for r in t}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_of_documents(spark, sf_dir):
    docs, _ = texts(sf_dir)
    assert result(queries.op4_ngram_jaccard(spark, sf_dir)) == brute_components(docs.items())


def variants():
    """Chains of near copies that are not all similar to each other, copies, and strangers sharing a passage."""
    base = [f"w{i}" for i in range(120)]
    rows, n = [], 0
    for step in range(8):       # each text differs from the next in a few words
        w = list(base)
        for k in range(step):
            w[5 + 14 * k] = f"x{step // 3}{k}"
        rows.append((n, " ".join(w)))
        n += 3
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(12):
        rows.append((n, passage + " " + " ".join(f"own{k}_{i}" for i in range(30 + k))))
        n += 1
    rows += [(n + k, "same text in many places of this table") for k in range(6)]
    n += 6
    for size in range(1, 12):   # small sets around the thresholds
        rows.append((n, " ".join(f"s{i}" for i in range(size))))
        rows.append((n + 1, " ".join([*(f"s{i}" for i in range(size - 1)), "other"])))
        n += 2
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_components_of_hard_cases(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = variants()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert result(got) == brute_components(rows)


@pytest.mark.parametrize("order", [(1, 30, 10, 40), (40, 30, 10, 1), (30, 40, 1, 10), (10, 1, 30, 40)])
def test_components_of_unordered_copies(spark, order):
    """Copies 10 and 30, near copies with a smaller and a larger doc_id, in one task in any order."""
    words = [f"w{i}" for i in range(80)]
    docs = {1: " ".join([*words[:-1], "x"]), 10: " ".join(words), 30: " ".join(words), 40: " ".join(["y", *words[1:]])}
    rows = [(i, docs[i]) for i in order] + [(100 + i, f"stranger {i} " + " ".join(f"s{i}_{k}" for k in range(30))) for i in order]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert result(got) == brute_components(sorted(rows))


def test_components_of_repeated_ids(spark):
    """Rows of a doc_id with different texts, some of them empty, share a component; every text counts."""
    rows = variants()
    ids = [i for i, _ in rows]
    rows += [(i, " ".join(f"z{w}" for w in t.split())) for i, (_, t) in zip(ids[1::2], rows)] + [(i, "") for i in ids[::3]] + [(i, None) for i in ids[-2:]]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert result(got) == brute_components(rows)


def test_components_odd(spark, odd_docs):
    got = [tuple(r) for r in jaccard.near_duplicates(odd_docs).collect()]
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == odd_docs.count()
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (1, 5) and by[6] == (1, 5)
    assert by[None] == (2, None) and by[8][1] == 7 and by[15][1] == 14
    assert jaccard.near_duplicates(odd_docs.where("false")).count() == 0


def test_pigeonhole():
    """Any similar pair of sets offers a cell in common, at every size."""
    import numpy as np
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 17, 26, 27, 40, 41, 61, 62, 92, 93, 139, 200, 209, 210, 400, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = int(rng.integers(0, max(1, size // 7) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, size // 6) + 1))).astype(np.uint64)]))
            if len(b) and jaccard.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                assert len(np.intersect1d(jaccard.cell_keys(a), jaccard.cell_keys(b)))
                apart = jaccard._apart(jaccard.parity_bits(a), jaccard.parity_bits(b))
                assert apart <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 7


def brute_rules(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k: k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules(spark, sf_dir, odd_docs):
    import public_tokenizers
    docs, _ = texts(sf_dir)
    for r in queries.op6_fertility(spark, sf_dir).collect():
        assert tuple(r[c] for c in RULES) == brute_rules(docs[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    got = fertility.scored(odd_docs, public_tokenizers.path(queries.PIECE_MODEL), carry=["text", "score"]).collect()
    assert len(got) == odd_docs.count()
    assert all(tuple(r[c] for c in RULES) == brute_rules(r["text"]) for r in got) and {r["score"] for r in got} == {"s"}
    assert fertility.scored(odd_docs.where("false"), public_tokenizers.path(queries.PIECE_MODEL)).count() == 0


def test_bands():
    assert fertility.script("Привет, мир") == "cyrillic" and fertility.script("été") == "latin" and fertility.script("12 !") == "other"
    assert fertility.within("latin", 500, 3.0, 0.0, 7.0)
    assert not fertility.within("latin", 500, 1.0, 0.0, 7.0) and not fertility.within("latin", 500, 3.0, 0.5, 7.0)
    assert not fertility.within("latin", 500, 3.0, 0.0, 1.0) and fertility.within("latin", 50, 3.0, 0.0, 1.0) and not fertility.within("latin", 0, None, None, None)


def test_scan_matches_regex():
    import pyarrow as pa
    rows = ["a b", None, "", "  x\x0by\x1fz\x85w  ", "é ü", "b a", "AB ab"]
    words = []
    for _, buf, off in scan.pieces(pa.array(rows)):
        w = scan.Words(buf, off)
        words += [[w.buf[a:z].tobytes().decode() for a, z in zip(w.starts[f:t], w.ends[f:t])] for f, t in zip(w.first[:-1], w.first[1:])]
        assert len(set(w.hashes.tolist())) == len({x for r in words for x in r})
    assert words == [WORD.findall(r or "") for r in rows]


def test_languages(spark, sf_dir, odd_docs):
    _, lang = texts(sf_dir)
    got = {r["doc_id"]: r for r in queries.op8_language(spark, sf_dir).collect()}
    out = [i for i, r in got.items() if r["held_out"]]
    assert len(got) == len(lang) and out
    assert sum(got[i]["lang_pred"] == lang[i] for i in out) / len(out) >= 0.95
    profiles = langid.learn(odd_docs)
    odd = [tuple(r) for r in langid.identified(odd_docs, profiles).collect()]
    assert len(odd) == odd_docs.count() and all(0 <= s <= 1 for _, _, s in odd)
    by = {i: n for i, n, _ in odd}
    assert by[1] == by[2] == by[3] == by[12] == "und" and by[7] == "en"
    assert langid.identified(odd_docs.where("false"), profiles).count() == 0
    assert langid.learn(odd_docs.where("false")).predict("text") == ("und", 0.0)


def test_out_of_place():
    p = langid.Profiles({"x": langid.ranked("abc abc abd", 50).tolist(), "y": langid.ranked("zzz zz z", 50).tolist()}, 50)
    own = langid.ranked("abc", 50)
    ranks = {c: k for k, c in enumerate(langid.ranked("abc abc abd", 50).tolist())}
    assert p.distance(own, 0) == sum(abs(ranks[c] - k) if c in ranks else 50 for k, c in enumerate(own.tolist()))
    assert p.predict("abc ab")[0] == "x" and p.predict("zzz")[0] == "y"


def test_lines(spark, odd_docs):
    rows = [(i, "menu\n" + ("rare\n" if i < 2 else "") + f"own {i}\n\nmenu", "h") for i in range(20)] + [(90, "menu\nalone", None), (91, None, "h"), (92, "menu", "small")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, host string, n int")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, "host").collect()}
    assert got[0]["text"] == "rare\nown 0\n" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 5 and got[0]["n"] == 5
    assert got[5]["text"] == "own 5\n" and got[90]["text"] == "menu\nalone" and got[91]["text"] is None and got[92]["text"] == "menu"
    assert line_dedup.drop_boilerplate(odd_docs, "source").count() == odd_docs.count()
    assert line_dedup.drop_boilerplate(odd_docs.where("false"), "source").count() == 0


def test_lines_of_a_language(spark):
    """A line on every fifth French page of a site that is mostly English goes; short lines and rare ones stay."""
    import corpus_pipeline
    menu, rare = "Tous les droits sont ici et encore reserves", "Une phrase qui ne se trouve que sur trois pages"
    rows = [(i, f"own {i}" + (f"\n{menu}\nOui." if i % 5 == 0 else "") + (f"\n{rare}" if i < 3 else ""), "fr", "s", 0) for i in range(40)]
    rows += [(100 + i, f"english {i}", "en", "s", 0) for i in range(300)] + [(500, menu, "fr", None, 0), (501, menu, None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, df, "").collect()}
    want = {r[0]: r[1].replace(f"\n{menu}", "") if r[0] < 40 else r[1] for r in rows}
    assert got == want
