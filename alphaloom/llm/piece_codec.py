"""SentencePiece merge-type encoding by backtracking, and decoding.

Merging proceeds by score, leftmost first on ties; a sequence of pieces is the merge result exactly if every two adjacent
pieces, joined and merged anew, come apart at the same place.  So the encoder walks left to right: Aho-Corasick gives the
longest piece at each position, the pair with the piece before it is checked by re-merging (remembered), shorter pieces
are tried in turn, and positions from which no way on was found are marked in a bit field and never tried again.

Characters outside the pieces become byte ids and part the text, as do the places before a space mark if no piece holds a
mark after another character; the segments between them are remembered, up to a bound.

Edge cases: null and empty texts have the begin and end ids alone; texts are encoded whole at any length; rows keep their
number and doc_id (null too); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, resident
from alphaloom.llm.wordbpe import read_vocabulary

MARK = "▁"
MEMO = 500_000          # segments, and as many pairs, a worker remembers before it starts anew (some 100 MB)
ROWS = 256


class PieceCodec:
    def __init__(self, model: bytes, memo: int = MEMO):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)} | set(byte)
        self.bos, self.eos, self.limit = sp.bos_id(), sp.eos_id(), memo
        self.byte = {int(self.pieces[i][3:5], 16): i for i in byte}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.known = {c for p in self.id for c in p}
        if len(self.byte) < 256 or not all(c in self.id for c in self.known) or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("needs byte pieces, no unused pieces, and every character as a piece")
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1)
                        if p in self.id else -1 for p in self.pieces]
        # where a segment may end for certain
        parted = not any(MARK in p.lstrip(MARK) for p in self.id)
        breaks = "" if "\n" in self.known else "\n"
        self.segment = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|{breaks}" if breaks else "")) if parted else re.compile("(?s).+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        for i in skip - set(byte):
            self.raw[i] = b""
        self.unknown = sp.unk_id()

    def merged(self, text: str) -> list[str]:
        """Plain merging, highest score first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (a < 0: begin the text)."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            pair = [self.pieces[i] for i in (key if a >= 0 else key[1:])]
            self.pairs[key] = self.merged("".join(pair)) == pair
        return self.pairs[key]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        longest = [-1] * n
        for end, (i, size) in self.auto.iter(text):
            longest[end - size + 1] = i         # ends ascend, so the longest comes last
        length, shorter, pairs, fits = self.length, self.shorter, self.pairs, self._fits
        failed = bytearray(n // 8 + 1)
        out, at, prev, i = [], 0, -1, longest[0] if n else -1
        while at < n:
            while i >= 0:
                to = at + length[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    ok = pairs.get((prev, i))
                    if ok or ok is None and fits(prev, i):
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, prev = to, i
                i = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("no encoding")
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= length[last]
                prev, i = (out[-1] if out else -1), shorter[last]
        return out

    def _segment(self, s: str) -> bytes:
        known, ids = self.known, []
        if known.issuperset(s):
            ids = self.backtrack(s)
        else:
            at = 0
            for k, c in enumerate(s):
                if c not in known:
                    ids += self.backtrack(s[at:k])
                    ids += [self.byte[b] for b in c.encode()]
                    at = k + 1
            ids += self.backtrack(s[at:])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 4-byte ids with begin and end ids."""
        segs = self.segment.findall(MARK + text.replace(" ", MARK)) if text else []
        memo = self.memo
        try:
            body = b"".join([memo[s] for s in segs])
        except KeyError:
            out = []
            for s in segs:
                ids = memo.get(s)
                if ids is None:
                    ids = self._segment(s)
                    if len(memo) >= self.limit:
                        memo.clear()
                    if len(s) < 64:
                        memo[s] = ids
                out.append(ids)
            body = b"".join(out)
        return self.bos.to_bytes(4, "little") + body + self.eos.to_bytes(4, "little")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, equal to the library's ``decode(ids)``."""
        raw = self.raw
        whole = b"".join([raw[i] for i in ids])
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            return self.sp.decode(ids)          # stray bytes: rare, left to the library
        first = next((i for i in ids if raw[i]), None)
        if first is None or first in self._bytes or self.unknown in ids:
            return self.sp.decode(ids)
        return text[1:] if self.pieces[first].startswith(MARK) else text

    @property
    def _bytes(self) -> set[int]:
        if not hasattr(self, "_byte_ids"):
            self._byte_ids = set(self.byte.values())
        return self._byte_ids


def load(key: int, model) -> PieceCodec:
    """The worker's codec for a broadcast model; ``model`` is called when the worker has none."""
    return resident(("pieces", key), lambda: PieceCodec(model()))


def encoded(docs: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian 4-byte, if asked for), their SHA-256, the SHA-256 of the decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    key = zlib.crc32(model.value)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def run(batches):
        codec = load(key, lambda: model.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                ids = [codec.encode(t) for t in p.column(1).to_pylist()]
                back = [hashlib.sha256(codec.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in ids]
                yield batch(schema, doc_id=p.column(0), n_tokens=[len(x) // 4 for x in ids], decoded_sha256=back,
                            ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids], ids=ids)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)
