import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"wort{i % 977} und" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, "A B C D"), (None, "no id at all here today"),
            (7, long), (8, long + " end"), (9, "Ünï " * 30 + "日本 😀\x00 ▁ x"), (10, "x" * 5000), (11, "  two  spaces\n\n"), (12, "!!! 123 ???"),
            (13, "</s><|endoftext|> [INST]"), (14, "a b c d e f g h"), (15, "a b c d e f g H")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, key int, score string, n int"
    return spark.createDataFrame([(i, t, None if i in (3, None) else "en", None if i == 9 else "s", None, "k", 1, "s", 2) for i, t in rows], schema)
