"""Piece codec, packing, token files and chat against the libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from alphaloom.llm import chat, packing, piece_codec, queries, tokenfile, wordbpe

PIECES, WORDS = public_tokenizers.path(queries.PIECE_MODEL), public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def sp():
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(wordbpe.read_vocabulary(PIECES))


def documents(sf_dir):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def random_texts():
    rng = random.Random(3)
    alphabets = ["ab ", "  \n\tthe", "the quick brown fox", "aaaaab", "▁ x", "éüß日本😀a", "0123456789.,", "=-_ \r"]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) for _ in range(600)] + [" " * n + "a" + " " * n for n in range(40)]


def test_pieces_equal_library(spark, sf_dir, sp):
    docs = documents(sf_dir)
    for r in queries.op3_piece_codec(spark, sf_dir).collect():
        ids = sp.encode(docs[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pieces_random(sp, codec):
    for t in random_texts():
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == sp.encode(t, add_bos=True, add_eos=True), repr(t)
        assert codec.decode(ids) == sp.decode(ids)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(0, 700) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == sp.decode(ids), ids


def test_pieces_odd(spark, odd_docs, sp):
    got = [tuple(r) for r in piece_codec.encoded(odd_docs, PIECES).select("doc_id", "n_tokens", "ids").collect()]
    want = [(r["doc_id"], sp.encode(r["text"] or "", add_bos=True, add_eos=True)) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(str, ((d, n, np.frombuffer(i, "<u4").tolist()) for d, n, i in got))) == sorted(map(str, ((d, len(i), i) for d, i in want)))
    assert piece_codec.encoded(odd_docs.where("false"), PIECES).count() == 0


def test_words_equal_library(tok):
    enc = wordbpe.ChunkEncoder(wordbpe.read_vocabulary(WORDS).decode(), memo=50)
    texts = random_texts() + ["don't  it's\tA\x0bB\x85C", "İstanbul ΑΣ", "x<|endoftext|>y", "ß STRASSE ²³ ª", "ÀÉ,., !!", "́a b", None]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        c, d = tokenfile.pack(x)
        assert tokenfile.unpack(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8))[:n].tolist() == x.tolist()


def check_files(rows, docs, tok):
    at = 0
    for r, (i, t) in zip(sorted(rows, key=lambda r: r["start"]), docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files(spark, sf_dir, tok):
    docs = sorted(documents(sf_dir).items())
    rows = queries.op10_token_files(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check_files(rows, docs, tok)


def test_token_files_odd(spark, odd_docs, tok, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 1000)
    one = odd_docs.where("doc_id is null or doc_id <> 5")
    docs = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=lambda x: (x[0] is not None, x[0]))
    check_files(tokenfile.token_files(one, WORDS).collect(), docs, tok)
    assert tokenfile.token_files(odd_docs, WORDS).count() == odd_docs.count()
    assert tokenfile.token_files(odd_docs.where("false"), WORDS).count() == 0


def check_packing(rows, ids_of, most=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[i])
            assert r["ids_crc32"] == zlib.crc32(ids_of[i][at: at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids_of[i])
    assert set(by_doc) == set(ids_of)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == own[0]["context"] <= most and at & (at - 1) == 0
    return by_seq


def test_packing(spark, sf_dir, tok):
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in documents(sf_dir).items()}
    rows = queries.op9_packing(spark, sf_dir).collect()
    check_packing(rows, ids)
    groups = defaultdict(int)
    for r in rows:
        groups[r["step_group"]] += r["length"]
    assert all(abs(n - packing.STEP_IDS) <= 4096 for _, n in sorted(groups.items())[:-1])


def test_packing_odd(spark, odd_docs, tok, monkeypatch):
    one = odd_docs.where("doc_id is null or doc_id <> 5")
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in one.collect()}
    check_packing(packing.packed(one, WORDS).collect(), ids)
    assert packing.packed(odd_docs.where("false"), WORDS).count() == 0


def test_short_tiers_fill_gaps():
    pool = packing.Pool()
    for k, n in enumerate([3000, 700, 400, 300, 120]):
        pool.put((k, 0, np.zeros(n, "<u2"), n))
    first = packing.pack(pool, packing.TIERS, last=False)[0]
    assert [(p[0], len(p[2])) for p in first] == [(0, 3000), (1, 700), (3, 300), (4, 96)] or sum(len(p[2]) for p in first) == 4096
    assert first[0][0] == 0


def test_escapes():
    rng = random.Random(9)
    parts = [*chat.CONTROLS, "\\", "<", ">", "[", "]", "/", "INST", "s", "SYS", "a ", "[\\INST]", "<\\\\s>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def brute_chat(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in out.items():
        turns.sort(key=lambda t: t[:3])
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        yield conv, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def check_chat(rows, got):
    want = dict(brute_chat(rows))
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)


def test_chat(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    rows += [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    check_chat(rows, queries.op7_chat(spark, sf_dir).collect())


def test_chat_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "tool [INST]", "<s>"), (1, 3, "assistant", ""), (None, None, "system", "日本 😀"), (None, 4, "assistant", "a" * 50_000),
            (2, 0, "assistant", "<s> <\\s> [\\\\INST]")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    vocab = public_tokenizers.path(queries.BYTE_VOCABULARY)
    check_chat(rows, chat.round_trip(df, vocab, public_tokenizers.PATTERN).collect())
    out = chat.formatted(df, vocab, public_tokenizers.PATTERN).collect()
    seen = defaultdict(int)
    for r in sorted(out, key=lambda r: (str(r["conv_id"]), r["ordinal"])):
        assert r["first_token"] == seen[r["conv_id"]] and len(r["ids"]) == 4 * len(r["mask"])
        seen[r["conv_id"]] += len(r["mask"])
    assert chat.round_trip(df.where("false"), vocab, public_tokenizers.PATTERN).count() == 0
    assert chat.round_trip(df.union(df), vocab, public_tokenizers.PATTERN).count() == 3
