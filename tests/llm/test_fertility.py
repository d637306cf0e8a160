"""Fertility measures against the library, and entropy floors learned from labelled texts."""

import math
import os
from collections import Counter

import numpy as np
import pytest

from alphaloom.llm import fertility, queries

LARGER = "/root/testdata/sf0.01"


def model():
    import public_tokenizers
    return public_tokenizers.path(queries.PIECE_MODEL)


def measured(sp, text):
    """(tokens, characters per token, fallback share, entropy) by the library."""
    ids = sp.encode(text or "")
    if not ids:
        return 0, None, None, None
    bytes_ = [i for i in ids if sp.is_byte(i) and sp.id_to_piece(i) not in ("<0x09>", "<0x0A>", "<0x0D>")]
    p = [c / len(ids) for c in Counter(ids).values()]
    return len(ids), len(text) / len(ids), len(bytes_) / len(ids), -sum(x * math.log2(x) for x in p)


def test_measures(spark, sf_dir, odd_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_docs.select("doc_id", "text", "lang"))
    rows = fertility.scored(docs, model(), carry=["text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = measured(sp, r["text"])
        got = [r[c] for c in ("n_tokens", "chars_per_token", "fallback_share", "entropy")]
        assert all(a == b if a is None or b is None else math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want))
        assert r["kept"] == (not r["base_failed"] and fertility.within(r["script"], *want))


@pytest.mark.skipif(not os.path.exists(LARGER), reason="needs the larger tables")
def test_floors_reject_junk_and_keep_clean(spark):
    """Floors from 200 clean texts, judged on all others."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    floors = fertility.learn_floors(docs, labels, model(), bound=200)
    assert ("latin", None) in floors and all(isinstance(f, fertility.Floor) for f in floors.values())
    rows = fertility.scored(docs, model(), carry=["lang"], floors=floors, lang="lang").join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(clean) > 300 and sum(clean) >= 0.995 * len(clean)
    assert len(junk) > 20 and sum(junk) <= 0.25 * len(junk)
    for r in rows:
        f = floors.get(("latin", r["lang"])) or floors[("latin", None)]
        assert r["kept"] == fertility.within("latin", r["n_tokens"], r["chars_per_token"], r["fallback_share"], r["entropy"], floor=f)


def test_planted_junk(spark):
    """Word lists with a sign after each word fall below the floor, prose of any length does not."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    prose = [r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(12).collect()]
    junk = [" *** ".join(t.split()) for t in prose]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + [" ".join(prose[:6])] + junk)], "doc_id long, text string, lang string")
    floors = fertility.learn_floors(docs, labels, model())
    got = {r["doc_id"]: r["kept"] or r["base_failed"] for r in fertility.scored(df, model(), carry=["lang"], floors=floors, lang="lang").collect()}
    assert all(got[i] for i in range(13))
    failed = {r["doc_id"] for r in fertility.scored(df, model()).where("base_failed").collect()}
    assert all(not got[i] for i in range(13, 25) if i not in failed) and len(failed) < 12


def test_floor_shape():
    n = np.array([100.0, 200, 400, 800, 1600] * 30)
    f = fertility.Floor(n, 0.5 * np.log2(n) + np.resize([-0.1, 0.1, 0.0], len(n)))
    assert math.isclose(f.margin, max(1.1 * 0.1, 3.5 * f.margin / 3.5), rel_tol=0.6) and f.margin >= 0.11 - 1e-9
    assert f.least(100) < f.least(400) < f.least(1600) and math.isclose(f.least(1600), f.least(10**6)) and f.least(50) <= f.least(100) - 1
    same = fertility.Floor(np.full(100, 300.0), np.full(100, 6.0))                     # one length: level
    assert math.isclose(same.least(300), 6.0) and math.isclose(same.least(10**5), 6.0)


def test_nothing_to_learn(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (None, 1), (6, None), (7, 1)], "doc_id long, quality int")
    for d, l in ((odd_docs, labels), (odd_docs, labels.where("false")), (odd_docs.where("false"), labels)):
        assert fertility.learn_floors(d, l, model()) == {}
    rows = fertility.scored(odd_docs, model(), carry=["lang"], floors={}, lang="lang")
    assert rows.count() == odd_docs.count()
