"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their frequency rank in the corpus, so that common ids need one byte.  A rank takes one to four
little-endian bytes; four ranks share a control byte of four 2-bit lengths, and control and data bytes stand apart, so
numpy decodes a block by looking control bytes up in a table of lengths and gathering the data bytes.

File: magic; blocks; directory (offset, length, documents, ids of each block); its offset, its entries, magic.
Block: number of documents and of control bytes; doc ids; their null flags; id counts; control bytes; data bytes.  The
code of a document begins at a control byte of its own; up to three one-byte zeros fill its last one.

Edge cases: a null or empty text has the end id alone; a null doc_id sorts first and comes back null; repeated rows are
kept, ties of doc_id standing in order of their ids' checksum; an empty table gives no files and no rows; further
columns are ignored.  A text is held by one task whole, as Spark's row is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm import wordbpe
from alphaloom.llm.common import batch, binary, shuffle_partitions, stored
from alphaloom.llm.files import Appender, Ranges, open_fs
from alphaloom.sources.storage import scratch_path

MAGIC = b"VLTOKEN1"
END_ID = 2
BLOCK_IDS = 1 << 20          # a block is closed when it holds so many ids
FILE_IDS = 1 << 26           # ids a file is meant to hold
ROWS = 256                   # documents coded at a time

#: Lengths of the four ranks of each control byte, first rank in the lowest bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of one document's ranks."""
    n = len(ranks)
    v = np.zeros((n + 3) // 4 * 4, np.uint32)
    v[:n] = ranks
    code = ((v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    c = code.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks of whole control bytes, with what fills them up."""
    size = LENGTHS[control].reshape(-1)
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class FileWriter:
    def __init__(self, uri: str):
        self.out, self.blocks = Appender(uri), []
        self.out.write(MAGIC)
        self._fresh()

    def _fresh(self) -> None:
        self.ids, self.null, self.counts, self.control, self.data, self.held = [], [], [], [], [], 0

    def add(self, doc_id: int | None, ranks: np.ndarray) -> None:
        c, d = pack(ranks)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ranks))
        self.control.append(c)
        self.data.append(d)
        self.held += len(ranks)
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        control = b"".join(self.control)
        body = b"".join([struct.pack("<QQ", len(self.ids), len(control)), np.array(self.ids, "<i8").tobytes(),
                         np.array(self.null, "u1").tobytes(), np.array(self.counts, "<u8").tobytes(), control, *self.data])
        self.blocks.append((self.out.write(body), len(body), len(self.ids), self.held))
        self._fresh()

    def close(self) -> None:
        self.flush()
        at = self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(struct.pack("<QQ", at, len(self.blocks)) + MAGIC)
        self.out.close()


def read_file(uri: str, by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks of a file in order: (doc ids, id counts, all their ids)."""
    r = Ranges()
    end = r.size(uri)
    at, n, magic = struct.unpack("<QQ8s", r.read(uri, end - 24, 24))
    if magic != MAGIC:
        raise ValueError(f"not a token file: {uri}")
    for off, length, docs, _ in np.frombuffer(r.read(uri, at, n * 32), "<u8").reshape(-1, 4).tolist():
        body = np.frombuffer(r.read(uri, off, length), np.uint8)
        docs, n_control = body[:16].view("<u8").tolist()
        p = 16 + 8 * docs
        ids, null = body[16:p].view("<i8").tolist(), body[p: p + docs]
        counts = np.frombuffer(body[p + docs: p + 9 * docs].tobytes(), "<u8").astype(np.int64)
        p += 9 * docs
        ranks = unpack(body[p: p + n_control], body[p + n_control:])
        room = (counts + 3) // 4 * 4
        keep = np.ones(len(ranks), bool)
        tail = np.cumsum(room) - room + counts
        for k in range(3):
            keep[tail[room - counts > k] + k] = False
        yield [None if z else i for i, z in zip(ids, null.tolist())], counts, by_rank[ranks[keep]]
    r.close()


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Ids of every whole text with the end id: doc_id, n_tokens, ids_crc32, ids (little-endian, 2 or 4 bytes each)."""
    source = docs.sparkSession.sparkContext.broadcast(wordbpe.read_vocabulary(vocabulary))
    key = zlib.crc32(source.value)

    def encode(batches):
        enc = wordbpe.load(key, lambda: source.value.decode())
        last = np.array([end_id], enc.dtype)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                ids = [np.concatenate([x, last]) for x in enc.encode(p.column(1).to_pylist())]
                yield batch(TOKENS, doc_id=p.column(0), n_tokens=[len(x) for x in ids],
                            ids_crc32=[zlib.crc32(x.astype("<u4")) for x in ids], ids=binary([x.tobytes() for x in ids]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def id_width(vocabulary: str) -> tuple[int, str]:
    enc = wordbpe.ChunkEncoder(wordbpe.read_vocabulary(vocabulary).decode())
    return enc.size, enc.dtype


def id_counts(tokens: DataFrame, size: int, dtype: str) -> DataFrame:
    """(id, n) over the whole corpus; each task sends one row for each id it met."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=size)
        met = np.flatnonzero(total)
        yield batch(schema, id=pa.array(met, pa.int64()), n=pa.array(total[met]))

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, folder: str, size: int, dtype: str) -> DataFrame:
    """Write token files in ascending doc_id order; returns their list: file_no, path, n_docs, n_tokens.

    ``tokens`` must be a stored table.  The only thing gathered is one count for each id of the vocabulary.
    """
    spark = tokens.sparkSession
    counts = np.zeros(size, np.int64)
    for i, n in id_counts(tokens, size, dtype).collect():
        counts[i] = n
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    f, root = open_fs(folder)
    f.create_dir(root, recursive=True)
    with f.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)
    schema = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        w, no, docs, total = None, TaskContext.get().partitionId(), 0, 0
        path = f"{folder}/part-{no:06d}.tok"
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1)):
                w = w or FileWriter(path)
                x = ranks.value[np.frombuffer(ids.as_buffer(), dtype)]
                w.add(doc_id, x)
                docs, total = docs + 1, total + len(x)
        if w:
            w.close()
            yield batch(schema, file_no=[no], path=[path], n_docs=[docs], n_tokens=[total])

    parts = max(shuffle_partitions(spark), -(-int(counts.sum()) // FILE_IDS))
    # one exchange by doc_id; the further sort columns make the order of ties definite
    order = ["doc_id", "ids_crc32", "n_tokens"]
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.select("doc_id", "ids").mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long"), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    f, root = open_fs(folder)
    with f.open_input_file(f"{root}/ranks.bin") as x:
        by_rank = spark.sparkContext.broadcast(np.frombuffer(x.read(), "<u4"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for docs, counts, ids in read_file(path, by_rank.value):
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                    yield batch(schema, doc_id=docs, start=pa.array(ends - counts + at), n_tokens=pa.array(counts), ids_crc32=crc)
                    at += int(ends[-1])

    # one row for each file: its ids go after those of the files before it
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (files.select("path", before.alias("at"), "file_no").repartition(shuffle_partitions(spark), "file_no")
            .select("path", "at").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Encode all texts, write the files and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "tok")
    size, dtype = id_width(vocabulary)
    tokens = stored(tokenised(docs, vocabulary), "token-ids")
    return read_files(write_files(tokens, folder, size, dtype), folder)
