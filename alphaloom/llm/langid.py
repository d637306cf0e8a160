"""Language identification by rank-order profiles.

A profile lists a language's most frequent 1- to 3-grams of letters (words padded with a space).  A text's own list is
compared with each profile by the out-of-place distance: the sum over its n-grams of how far their ranks lie apart, with
the list's length for n-grams the profile lacks.  The nearest profile wins; ties go to the first name.

Profiles are learned from about ``FIT_DOCS`` whole texts of each language, chosen by a hash of doc_id: the only bounded
part.  Each task sums n-grams before they are shuffled; the profiles (``PROFILE`` n-grams for each of the languages, a
vocabulary that doesn't grow with the corpus) are broadcast.

Edge cases: null texts, and texts without a letter, are ``und`` with score 0, as are all texts if nothing could be learned;
rows without a language are never learned from; rows keep their number and doc_id (null too); further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import batch, stored, text_once, vacate

PROFILE = 400
FIT_DOCS = 2000
UNDETERMINED = "und"
ROWS = 256

_BITS = np.int64(21)
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _alpha


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of the text: up to three code points plus one, 1 for a space, 0 for none."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    x = np.ones(len(cp) + 2, np.int64)
    x[1:-1] = np.where(_letters()[cp], cp + 1, 1)
    x = x[np.concatenate([[True], (x[1:] != 1) | (x[:-1] != 1)])]
    if x[-1] != 1:
        x = np.append(x, 1)
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = x[:-1] << _BITS | x[1:]
    three = (a << _BITS | b) << _BITS | c
    return np.concatenate([x[x != 1], two, three[b != 1]]) if len(x) > 1 else x[:0]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(codes)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[edge], np.diff(np.append(edge, len(s)))


def ranked(text: str | None, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, first first; ties by code."""
    code, n = counted(ngrams(text))
    if len(n) > 4 * size:       # only those that may be among the first
        least = np.partition(n, len(n) - size)[len(n) - size]
        code, n = code[n >= least], n[n >= least]
    return code[np.lexsort((code, -n))][:size]


class Profiles:
    """Profiles by language, each a list of codes by rank."""

    def __init__(self, lists: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(lists), size
        self.codes, self.ranks = [], []
        for name in self.names:
            code = np.array(lists[name], np.int64)
            order = np.argsort(code)
            self.codes.append(code[order])
            self.ranks.append(order)

    def distance(self, own: np.ndarray, k: int) -> int:
        code, rank = self.codes[k], self.ranks[k]
        at = np.minimum(np.searchsorted(code, own), len(code) - 1)
        hit = code[at] == own
        return int(np.where(hit, np.abs(rank[at] - np.arange(len(own))), self.size).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the nearest distance's distance from the worst one, as a share of it."""
        own = ranked(text, self.size)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        d = [self.distance(own, k) for k in range(len(self.names))]
        best = int(np.argmin(d))
        return self.names[best], 1.0 - d[best] / (self.size * len(own))


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles of the non-null values of lang among the given documents."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.count(F.lit(1))).alias("share"))
    chosen = rows.join(stored(share, "lang-shares"), "lang").where("u < share")     # one row a language
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches):
        vacate()
        total: dict[str, list] = {}

        def packed(name):
            code, n = zip(*total[name])
            code, n = np.concatenate(code), np.concatenate(n)
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
            return code[edge], np.add.reduceat(n, edge) if len(edge) else n
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = total.setdefault(name, [])
                parts.append(counted(ngrams(text)))
                if len(parts) >= 64:
                    total[name] = [packed(name)]
        for name in total:
            code, n = packed(name)
            yield batch(schema, lang=[name] * len(code), code=pa.array(code), n=pa.array(n.astype(np.int64)))

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    lists: dict[str, list[int]] = {}
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    for name, code in sums.withColumn("r", first).where(F.col("r") <= size).orderBy("lang", "r").select("lang", "code").collect():
        lists.setdefault(name, []).append(code)
    return Profiles(lists, size)


def identified(docs: DataFrame, profiles: Profiles, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of each whole text, beside the columns named by ``carry``."""
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows_in, place = text_once(docs, carry)
    own = {"doc_id": "long", "lang_pred": "string", "score": "double"}
    new = [c for c in own if c not in carry]

    def run(batches):
        vacate()
        prof = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                got = [prof.predict(t) for t in p.column(place).to_pylist()]
                made = {"doc_id": p.column(0), "lang_pred": pa.array([g for g, _ in got], pa.string()), "score": pa.array([s for _, s in got], pa.float64())}
                yield pa.RecordBatch.from_arrays([p.column(1 + k) for k in range(len(carry))] + [made[c] for c in new], names=[*carry, *new])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.select(*carry).schema if carry else [])] + [f"{c} {own[c]}" for c in new]
    return rows_in.mapInArrow(run, ", ".join(ddl))


def held_out(doc_id: Column) -> Column:
    """Every fourth document, by a checksum of its id: never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2
