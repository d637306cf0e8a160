"""Chat formatting at token level.

Segments (texts, and roles that have no marker of their own) are encoded separately with a byte-level vocabulary, and the
reserved ids of the control strings, which lie above the vocabulary, are spliced between them.  Ends of segments are
prefix sums of their lengths, and the loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it
ends.  Positions in the conversation are prefix sums over its turns.

Control strings inside contents are escaped: one backslash is put after their first character, or one more where such
backslashes stand already.  So no control string is left, and taking one backslash away restores the text.

A row of the output is one turn, so that no conversation is ever gathered.  Edge cases: null texts and roles are empty;
a null conv_id is a conversation of its own; a null turn comes first; turns with the same number stand in order of role,
then of their ids; repeated rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, resident, shuffle_partitions, stored
from alphaloom.llm.wordbpe import read_vocabulary

# fixed values: the template's control strings, in the order of their reserved ids
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
# fixed values: opening and closing control string of the roles the template knows
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]")

_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Template:
    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.first = max(table.values()) + 2            # the id after the vocabulary is its own end mark
        self.id = {c: self.first + k for k, c in enumerate(CONTROLS)}
        self.role = {self.id[a]: r for r, (a, _) in ROLES.items()}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of one turn."""
        known = role in ROLES
        a, b = ROLES[role if known else "user"]
        segments = [] if known else [[self.id[OTHER[0]]], self.enc.encode_ordinary(escape(role)), [self.id[OTHER[1]]]]
        segments += [[self.id[a]], self.enc.encode_ordinary(escape(text)), [self.id[b]]]
        ends = np.cumsum([len(s) for s in segments])
        edge = np.zeros(ends[-1] + 1, np.int8)
        if role == "assistant":
            edge[ends[-3]] += 1
            edge[ends[-2]] -= 1
        return np.array([i for s in segments for i in s], "<u4"), np.cumsum(edge[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """Spelled-out template text of ids, control strings included."""
        out, at = [], 0
        for k in [*np.flatnonzero(ids >= self.first).tolist(), len(ids)]:
            out.append(self.enc.decode_bytes(ids[at:k].tolist()).decode())
            if k < len(ids):
                out.append(CONTROLS[int(ids[k]) - self.first])
            at = k + 1
        return "".join(out)

    def parse(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of one turn's ids."""
        marks = np.flatnonzero(ids >= self.first).tolist()
        parts = [unescape(self.enc.decode_bytes(ids[a + 1: b].tolist()).decode()) for a, b in zip(marks[::2], marks[1::2])]
        return (parts[0], parts[1]) if len(parts) > 1 else (self.role[int(ids[0])], parts[0])


def _template(spark, vocabulary: str, pattern: str):
    source = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = zlib.crc32(source.value)

    return lambda: resident(("chat", key), lambda: Template(source.value, pattern))


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("n_tokens", pa.int64()),
                   ("ids", pa.binary()), ("mask", pa.binary())])


def formatted(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row a turn: conv_id, ordinal (from 0), first_token in the conversation, ids (4-byte), mask (a byte an id)."""
    template = _template(turns.sparkSession, vocabulary, pattern)

    def run(batches):
        t = template()
        for b in batches:
            roles = [r or "" for r in b.column(2).to_pylist()]
            made = [t.turn(r, x or "") for r, x in zip(roles, b.column(3).to_pylist())]
            yield batch(TURNS, conv_id=b.column(0), turn=b.column(1), role=roles, n_tokens=[len(i) for i, _ in made],
                        ids=[i.tobytes() for i, _ in made], mask=[m.tobytes() for _, m in made])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    made = rows.mapInArrow(run, "conv_id long, turn long, role string, n_tokens long, ids binary, mask binary")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
                       F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"), "ids", "mask")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])


def digests(output: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Read the output back, a conversation at a time in order of its turns, holding one turn and two running digests."""
    template = _template(output.sparkSession, vocabulary, pattern)

    def run(batches):
        t, now, row = template(), None, None

        def done():
            return batch(READ, conv_id=[now[0]], n_turns=[row[0]], turns_sha256=[row[1].hexdigest()], loss_chars=[row[2]],
                         loss_sha256=[row[3].hexdigest()], formatted_chars=[row[4]], n_tokens=[row[5]])

        for b in batches:
            for conv, raw, mask in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if now != (conv,):
                    if now:
                        yield done()
                    now, row = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                role, text = t.parse(ids)
                loss = unescape(t.text(ids[np.frombuffer(mask.as_buffer(), np.int8) > 0]))
                row[0] += 1
                row[1].update(f"{role}\n{text}\n".encode())
                row[2] += len(loss)
                row[3].update(loss.encode())
                row[4] += len(t.text(ids))
                row[5] += len(ids)
        if now:
            yield done()

    dealt = output.repartition(shuffle_partitions(output.sparkSession), "conv_id").sortWithinPartitions("conv_id", "ordinal")
    return dealt.select("conv_id", "ids", "mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def round_trip(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    return digests(stored(formatted(turns, vocabulary, pattern), "chat"), vocabulary, pattern)
