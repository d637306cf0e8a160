"""What a text's measures cost: nothing of the vocabulary's size, and no segment encoded twice within the memo."""

import numpy as np
import public_tokenizers
import pytest

from alphaloom.llm import fertility, piece_codec
from alphaloom.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        return piece_codec.PieceCodec(f.read())


@pytest.mark.parametrize("text", ["a", "aa aa aa", "the cat sat on the mat, the cat", "\u2603\U0001F600 x\n\ty", "Ünïcödé " * 40, "z" * 3000])
def test_measures_of_counts(codec, text):
    f = fertility.Fertility(codec)
    ids = np.frombuffer(codec.encode(text), "<u4")[1:-1]
    counts = np.bincount(ids, minlength=len(codec.pieces))
    p = counts[counts > 0] / len(ids)
    assert f.measure(text) == (len(ids), len(text) / len(ids), float(counts[f.fallback].sum() / len(ids)), float(-(p * np.log2(p)).sum()))


def test_no_array_of_the_vocabulary(codec, monkeypatch):
    def refuse(*_args, **_more):
        raise AssertionError("counted over the whole vocabulary")
    monkeypatch.setattr(np, "bincount", refuse)
    assert fertility.Fertility(codec).measure("a few words of text")[0] > 0


def test_segments_are_encoded_once(codec, monkeypatch):
    seen = []
    monkeypatch.setattr(codec, "memo", {})
    monkeypatch.setattr(codec, "_segment", lambda s: seen.append(s) or b"")
    text = " ".join(f"w{i}" for i in range(300_000))
    codec.encode(text)
    codec.encode(text)
    assert len(seen) == len(set(seen)) == 300_000
