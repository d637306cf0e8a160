"""Archives, nearest neighbours and the pipeline."""

import base64
import hashlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from alphaloom.llm import components, nndescent, queries, warc


def brute_archive(rows):
    keep = {}
    for i, html in rows:
        if i is not None:
            keep[html or ""] = max(i, keep.get(html or "", i))
    for i, html in rows:
        raw, top = (html or "").encode(), keep.get(html or "")
        own = top is None or i == top
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else top


def check_archive(got, rows):
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(str(tuple(r[c] for c in cols)) for r in got) == sorted(map(str, brute_archive(rows)))


def test_archive(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()]
    check_archive(queries.op2_warc(spark, sf_dir).collect(), rows)


def test_archive_odd(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(1, "http://a.b/x", "p"), (2, "http://a.b/x", "p"), (3, None, None), (4, "", ""), (None, "http://é.org/ü y", "p"), (5, "http://[bad", "q"),
            (6, "HTTP://User@A.B:81/x?q=1#f", "日本\r\n\r\n"), (7, "http://a.b/x", "z" * 2_000_000), (8, "http://c/", "r"), (8, "http://c/", "r")]
    rows += [(100 + i, "http://hot.example/", f"page {i // 2}") for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(4)
    check_archive(warc.archived(df).collect(), [(i, h) for i, _, h in rows])
    assert warc.archived(df.where("false")).count() == 0


def test_keys():
    assert warc.url_key("https://Shop.Example.org/a?b#c") == "org,example,shop)/a?b" and warc.url_key(None) == "-"
    assert warc.url_key("http://x.y") == "y,x)/" and " " not in warc.url_key("http://x/a b\n")


def brute_nearest(vecs, queries_, k=20):
    ids = sorted(vecs)
    x = np.stack([vecs[i] for i in ids]).astype(np.float64)
    for q in queries_:
        s = x @ vecs[q].astype(np.float64)
        yield q, [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]


def recall(got, vecs, queries_):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q, want in brute_nearest(vecs, queries_):
        own = [found[q][k + 1] for k in range(len(found[q]))]
        assert [i for i, _ in sorted(own, key=lambda p: (-p[1], p[0]))] == [i for i, _ in own] and q not in dict(own)
        assert all(abs(s - float(vecs[i].astype(np.float64) @ vecs[q].astype(np.float64))) < 1e-12 for i, s in own)
        hit += len({i for i, _ in own} & {i for i, _ in want})
        total += len(want)
    return hit / total


def test_nearest(spark, sf_dir):
    vecs = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()}
    assert recall(queries.op5_nearest(spark, sf_dir).collect(), vecs, [i for i in vecs if i % 20 == 0]) >= 0.9


def test_nearest_odd(spark):
    rng = np.random.default_rng(2)
    vecs = {i: rng.standard_normal(8).astype(np.float32) for i in range(300)} | {i: 3 * np.ones(8, np.float32) for i in range(300, 400)}
    bad = [(None, [1.0] * 8), (900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [float("inf")] * 8), (980, [None] + [1.0] * 7), (1000, [1.0])]
    rows = [(i, [float(x) for x in v], 1) for i, v in vecs.items()] + [(i, v, 1) for i, v in bad] + [(20, [float(x) for x in vecs[20]], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = nndescent.nearest(df, "id % 20 = 0").collect()
    assert recall(got, vecs, [i for i in vecs if i % 20 == 0]) >= 0.95
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 320] == [i for i in range(300, 321) if i != 320]
    assert nndescent.nearest(df.where("false"), "id % 20 = 0").count() == 0
    assert nndescent.nearest(df.where("vec_id = 20"), "id % 20 = 0").count() == 0
    assert nndescent.nearest(df.where("vec_id in (20, 21)"), "id % 20 = 0").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 300), (300, 200), (7, 7), (100, 300)] + [(500, i) for i in range(501, 540)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 200, 300)} | {(i, 500) for i in range(500, 540)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir, odd_docs):
    from tests.llm.test_text import brute_components, brute_rules
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        after = out.collect()
        ids = {r["doc_id"] for r in after}
        if name == "quality_rules":
            assert ids == {r["doc_id"] for r in before if not brute_rules(r["text"])[-1]}
        if name == "language_id":
            assert ids == {r["doc_id"] for r in before}
        if name == "line_dedup":
            assert ids == {r["doc_id"] for r in before} and all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "near_duplicates":
            assert ids == {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in before]) if i == c}
        docs = spark.createDataFrame(after, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in packed}


def test_pipeline_odd(spark, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, odd_docs, "").collect()]
    assert kept.count(5) == 1 and None in kept and 6 not in kept and 8 not in kept


def test_own_columns_stay(spark, sf_dir):
    """Columns named like a stage's own ones, and a null lang."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) as lang", "source", "n_chars", "cast(doc_id as string) as kept",
                          "doc_id * 2 as score", "'mine' as lang_pred", "doc_id as n_words", "-1 as entropy").collect()
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, kept string, score long, lang_pred string, n_words long, entropy int")
    given = {r["doc_id"]: r for r in odd}
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = corpus_pipeline.quality_rules(spark, df, sf_dir)
    assert out.columns == df.columns and all(r == given[r["doc_id"]] for r in out.collect())
    out = corpus_pipeline.language_id(spark, df, sf_dir)
    rows = out.collect()
    assert out.columns == df.columns and rows
    assert all((r["kept"], r["score"], r["lang_pred"], r["n_words"], r["entropy"]) == (str(r["doc_id"]), 2 * r["doc_id"], "mine", r["doc_id"], -1) for r in rows)
    assert all(r["lang"] == langs[r["doc_id"]] for r in rows if r["doc_id"] % 5)
    filled = [r["lang"] == langs[r["doc_id"]] for r in rows if r["doc_id"] % 5 == 0]
    assert sum(filled) >= 0.95 * len(filled) > 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of a doc_id with texts of their own stay; copies and near copies among them go."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (5, b), (5, c), (5, a), (7, b + " end"), (7, b + " end"), (8, ""), (8, ""), (8, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (5, c), (8, ""), (8, None), (None, a)], key=str)
