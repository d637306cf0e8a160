"""Floors from all clean texts: the distributed fit against numpy, and that no labelled text is left out."""

import numpy as np
import pytest

from alphaloom.llm import fertility


def test_fit_takes_every_clean_text(spark):
    rng = np.random.default_rng(4)
    n = 3000
    tokens = rng.integers(100, 20_000, n)
    entropy = 3 + 0.4 * np.log2(tokens) + rng.normal(0, 0.05, n)
    for worst in (int(rng.integers(n)), int(rng.integers(n))):          # wherever it stands, the worst text widens the margin
        e = entropy.copy()
        e[worst] -= 2.0
        langs = ["de" if i % 3 else None for i in range(n)]
        rows = [(i, "latin", langs[i], int(t), float(v), False) for i, (t, v) in enumerate(zip(tokens, e))]
        rows += [(0, "latin", "de", 50_000, 0.1, True), (n, "latin", "de", 500, 0.1, False)]        # fails the base rules; labelled 0
        m = spark.createDataFrame(rows, "doc_id long, script string, lang string, n_tokens long, entropy double, base_failed boolean")
        labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(n, 0)], "doc_id long, quality int")
        got = fertility.floors_of(m, labels)
        assert set(got) == {("latin", None), ("latin", "de")}
        for key, at in ((("latin", None), np.ones(n, bool)), (("latin", "de"), np.array([x is not None for x in langs]))):
            want = fertility.Floor(tokens[at].astype(float), e[at])
            assert got[key].margin == pytest.approx(want.margin, rel=1e-6)
            assert all(got[key].least(k) == pytest.approx(want.least(k), abs=1e-6) for k in (10, 100, 5000, 10**6))


def test_query_keeps_every_clean_text(spark):
    """A floor rejects none of the texts it was learned from, through the stored measures."""
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    words = "der die das und oder aber nicht sehr gut haus baum stadt fluss berg tal weg licht nacht tag jahr".split()
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(words[k] for k in rng.integers(0, len(words), int(rng.integers(80, 900)))), "de") for i in range(150)], "doc_id long, text string, lang string")
    import public_tokenizers

    from alphaloom.llm import queries
    got = fertility.judged(docs, labels, public_tokenizers.path(queries.PIECE_MODEL), ["lang"], "lang").collect()
    bare = {r["doc_id"]: r["kept"] for r in fertility.scored(docs, public_tokenizers.path(queries.PIECE_MODEL)).collect()}
    assert len(got) == 150 and all(r["kept"] == bare[r["doc_id"]] for r in got)
