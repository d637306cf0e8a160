"""Exact ids of a tokenizers vocabulary with a bounded memo of space-separated chunks.

The word vocabulary drops white space, so a text's ids are those of its chunks in order.  A chunk is encoded by the
tokenizers library the first time a worker meets it; texts of other vocabularies go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from alphaloom.llm.common import resident

MEMO = 700_000          # chunks a worker remembers before it starts anew
GROUP = 64              # texts whose unseen chunks are encoded together


class ChunkEncoder:
    def __init__(self, source: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tok, self.limit = Tokenizer.from_str(source), memo
        self.letters = Tokenizer.from_str(source)       # for lower-case words of letters, which need no normalising
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        spec = json.loads(source)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        end = (spec["model"].get("end_of_word_suffix") or "")
        self.ends = np.zeros(self.size, bool)
        for piece, i in vocab.items():
            self.ends[i] = bool(end) and piece.endswith(end)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunked = bool(end) and _drops_spaces(self.tok, self.specials)
        self.memo: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        memo = self.memo
        plain, pointed, odd = set(), [], []
        for c in chunks:
            if c and (c.isascii() or _latin(c)) and c == c.lower():
                if c.isalpha():
                    plain.add(c)
                    continue
                if c[-1] in ".,!" and c[:-1].isalpha():
                    pointed.append(c)
                    if c[:-1] not in memo:
                        plain.add(c[:-1])
                    continue
            odd.append(c)
        words = list(plain)
        for at in range(0, len(words), 256):        # letters only: one pre-token each, whose last id bears the end mark
            part = words[at: at + 256]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                for w in part:
                    memo[w] = self._library(w)
                continue
            size, raw, a = ids.itemsize, ids.tobytes(), 0
            for w, b in zip(part, (cut * size).tolist()):
                memo[w] = raw[a:b]
                a = b
        for c in pointed:
            if c[-1] not in memo:
                memo[c[-1]] = self._library(c[-1])
            memo[c] = memo[c[:-1]] + memo[c[-1]]
        for c in odd:
            memo[c] = self._library(c)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), equal to ``encode(text, add_special_tokens=False).ids``."""
        if not self.chunked:
            return [np.array(e.ids, self.dtype) for e in
                    self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out = []
        for at in range(0, len(texts), GROUP):
            out += self._group(texts[at: at + GROUP])
        return out

    def _group(self, texts: list[str | None]) -> list[np.ndarray]:
        memo, rows, seen = self.memo, [], set()
        memo[""] = b""
        for t in texts:
            t = t or ""
            if any(s in t for s in self.specials):
                rows.append(self._library(t))
                continue
            rows.append((t.lower() if _latin(t) else t).replace("\n", " ").split(" "))
            seen.update(rows[-1])
        if new := seen.difference(memo):
            if len(memo) + len(new) > self.limit:       # start anew, with what these texts need
                memo.clear()
                memo[""] = b""
                new = seen
            self._learn(new)
        return [np.frombuffer(r if isinstance(r, bytes) else b"".join([memo[c] for c in r]), self.dtype) for r in rows]


def _latin(t: str) -> bool:
    """Only code points below 256, where lower case and composition go character by character."""
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _drops_spaces(tok, specials: list[str]) -> bool:
    probe = "Ab, cd.\n\n  éf 12 x"
    parts = [i for c in probe.replace("\n", " ").split(" ") for i in tok.encode(c, add_special_tokens=False).ids]
    return parts == tok.encode(probe, add_special_tokens=False).ids


def load(key: int, source, memo: int = MEMO) -> ChunkEncoder:
    """The worker's encoder for a broadcast vocabulary; ``source`` is called when the worker has none."""
    return resident(("words", key, memo), lambda: ChunkEncoder(source(), memo))


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes (a few MB whatever the corpus), to be broadcast."""
    with open(path, "rb") as f:
        return f.read()
