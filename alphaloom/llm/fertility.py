"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each whole text: characters per token, the share of tokens that are single
fallback bytes (line ends and tabs aside), and the entropy of its tokens.  A text is rejected if a measure leaves the band
of its main script.  Base rules on words, symbols and repetition come first.

The entropy that prose reaches depends on its length and language, so floors can be learned (``learn_floors``) from texts
labelled clean: a curve over the logarithm of the token count for each language with enough of them, and for each script,
less a margin.  Text without floors of its own language takes those of its script, and without these the fixed band.

Edge cases: null and empty texts have no words, so the base rules reject them; texts without tokens have null measures;
short texts (under ``MIN_TOKENS`` tokens) are not held to the entropy band; rows keep their number and doc_id (null too);
further columns are ignored; an empty table gives no rows.  Floors: null languages count for the script alone; doc_ids
labelled both ways, null doc_ids and null labels teach nothing; of a repeated doc_id the text with most tokens teaches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import piece_codec, scan
from alphaloom.llm.common import stored, text_once
from alphaloom.llm.wordbpe import read_vocabulary

# fixed values: script, first and last code point of its main blocks
SCRIPTS = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F),
           ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
# fixed values: script, least and most characters per token, most fallback-byte share, least entropy in bits
BANDS = {
    "latin": (1.45, 6.5, 0.10, 4.0), "greek": (0.8, 5.0, 0.30, 3.5), "cyrillic": (1.0, 5.5, 0.20, 4.0),
    "hebrew": (0.4, 4.0, 0.60, 3.5), "arabic": (0.4, 4.0, 0.60, 3.5), "devanagari": (0.3, 4.0, 0.80, 3.0),
    "thai": (0.3, 4.0, 0.80, 3.0), "kana": (0.4, 3.0, 0.60, 3.5), "han": (0.3, 3.0, 0.75, 3.5),
    "hangul": (0.3, 3.0, 0.80, 3.5), "other": (0.2, 8.0, 1.00, 0.0),
}
MIN_WORDS = 50
MIN_TOKENS = 100
SYMBOLS = b"#*$%&|<>"
FIT_LEAST = 100                 # a language or script with fewer of them has no floors of its own
BEYOND, SPREADS = 1.1, 3.5      # the margin: the worst clean text times the one, or so many deviations, whichever is wider
ROWS = 256

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_names = sorted({s for s, _, _ in SCRIPTS})
_edges = sorted((a, b, s) for s, a, b in SCRIPTS)
_FIRST = np.array([a for a, _, _ in _edges])
_LAST = np.array([b for _, b, _ in _edges])
_INDEX = np.array([_names.index(s) for _, _, s in _edges])


def script(text: str) -> str:
    """The script with most code points of the text; ``other`` if none of the known ones occurs."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    cp = cp[(cp >= 0x41) & ~((cp > 0x5A) & (cp < 0x61)) & ~((cp > 0x7A) & (cp < 0xAA))]
    at = np.searchsorted(_FIRST, cp, "right") - 1
    hit = (at >= 0) & (cp <= _LAST[at])
    if not hit.any():
        return "other"
    return _names[int(np.bincount(_INDEX[at[hit]], minlength=len(_names)).argmax())]


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    w = scan.windows(h, 3)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


class Fertility:
    """Measures of one text's ids."""

    def __init__(self, codec: piece_codec.PieceCodec):
        self.codec, n = codec, len(codec.pieces)
        self.fallback = np.zeros(n, bool)
        for b, i in codec.byte.items():
            self.fallback[i] = b not in (0x09, 0x0A, 0x0D)

    def measure(self, text: str) -> tuple[int, float | None, float | None, float | None]:
        """(tokens, characters per token, fallback-byte share, entropy in bits)."""
        ids = np.frombuffer(self.codec.encode(text), "<u4")[1:-1]
        n = len(ids)
        if not n:
            return 0, None, None, None
        # by sorting: an array as long as the vocabulary costs more than most texts
        ordered = np.sort(ids)
        p = np.diff(np.flatnonzero(ordered[1:] != ordered[:-1]), prepend=-1, append=n - 1) / n
        return n, len(text) / n, float(np.count_nonzero(self.fallback[ids]) / n), float(-(p * np.log2(p)).sum())


class Floor:
    """Least entropy by token count: a parabola over log2, held level outside the lengths it was learned from."""

    def __init__(self, tokens: np.ndarray, entropy: np.ndarray):
        x = np.log2(tokens)
        self.shortest, self.longest = float(x.min()), float(x.max())
        self.curve = np.polyfit(x, entropy, 2 if self.longest - self.shortest >= 1 else 0)
        off = entropy - np.polyval(self.curve, x)
        self.margin = float(max(BEYOND * -off.min(), SPREADS * off.std()))

    @classmethod
    def known(cls, curve: np.ndarray, shortest: float, longest: float, margin: float) -> Floor:
        f = cls.__new__(cls)
        f.curve, f.shortest, f.longest, f.margin = curve, shortest, longest, margin
        return f

    def least(self, n: int) -> float:
        x = float(np.log2(n))
        # a token more adds at most what its logarithm does, so shorter texts get a bit less for each halving
        return float(np.polyval(self.curve, min(max(x, self.shortest), self.longest))) - self.margin - max(0.0, self.shortest - x)


def floors_of(measured: DataFrame, labels: DataFrame, lang: str = "lang", bound: int | None = None) -> dict:
    """{(script, language or None): Floor} from all measured texts labelled clean that pass the base rules.

    ``measured``: a stored table from :func:`scored`; ``labels``: (doc_id, quality), 1 is clean; ``bound``: learn from so many
    labelled doc_ids at most.  Curves are fitted from sums over the texts; a row for each script and language reaches the driver.
    """
    clean = _clean(labels, bound)
    fit = measured.where(f"not base_failed and n_tokens >= {MIN_TOKENS}").select("doc_id", "script", F.col(lang).cast("string").alias("lang"), "n_tokens", "entropy")
    once = fit.join(clean, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "entropy", "script", "lang")).alias("m"))
    of = lambda own: F.struct("m.script", F.coalesce("m.lang", F.lit("")).alias("lang") if own else F.lit("").alias("lang"), F.lit(own).alias("own"))
    both = F.when(F.col("m.lang").isNull(), F.array(of(False))).otherwise(F.array(of(True), of(False)))
    rows = once.select(F.explode(both).alias("g"), F.log2("m.n_tokens").alias("x"), F.col("m.entropy").alias("y")).select("g.*", "x", "y")
    rows = stored(rows, "clean-measures")
    group = ["script", "lang", "own"]
    spark = measured.sparkSession

    def beside(stats: dict, names: str) -> DataFrame:
        return rows.join(F.broadcast(spark.createDataFrame([(*k, *v) for k, v in stats.items()], f"script string, lang string, own boolean, {names}")), group)

    ends = {tuple(r[:3]): tuple(r[3:]) for r in rows.groupBy(*group).agg(F.avg("x"), F.min("x"), F.max("x"), F.count("*").alias("n")).where(F.col("n") >= FIT_LEAST).collect()}
    if not ends:
        return {}
    u = F.col("x") - F.col("mid")
    sums = [F.sum(F.pow(u, F.lit(float(i)))) for i in range(5)] + [F.sum(F.pow(u, F.lit(float(i))) * F.col("y")) for i in range(3)]
    curves = {}
    for r in beside({k: (v[0],) for k, v in ends.items()}, "mid double").groupBy(*group).agg(*sums).collect():
        (mid, low, high, _), s = ends[tuple(r[:3])], r[3:]
        size = 3 if high - low >= 1 else 1
        c = np.zeros(3)
        c[:size] = np.linalg.lstsq(np.array([[s[i + j] for j in range(size)] for i in range(size)]), np.array(s[5: 5 + size]), rcond=None)[0]
        curves[tuple(r[:3])] = (float(c[2]), float(c[1]), float(c[0]), mid)
    off = F.col("y") - ((F.col("a") * u + F.col("b")) * u + F.col("c"))
    floors = {}
    for name, language, own, worst, spread in beside(curves, "a double, b double, c double, mid double").groupBy(*group).agg(F.min(off), F.stddev_pop(off)).collect():
        (a, b, c, mid), (_, low, high, _) = curves[name, language, own], ends[name, language, own]
        floors[name, language if own else None] = Floor.known(np.array([a, b - 2 * a * mid, c - b * mid + a * mid * mid]), low, high, max(BEYOND * -worst, SPREADS * spread))
    return floors


def _clean(labels: DataFrame, bound: int | None) -> DataFrame:
    """doc_ids labelled clean and nothing else."""
    clean = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    return clean if bound is None else clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learn_floors(docs: DataFrame, labels: DataFrame, model_path: str, lang: str = "lang", bound: int | None = None) -> dict:
    """The floors of :func:`floors_of` for texts not measured yet; only those labelled clean (all, or ``bound`` of them) are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang).cast("string").alias("lang")).join(_clean(labels, bound), "doc_id", "left_semi")
    return floors_of(stored(scored(texts, model_path, carry=["lang"]), "measures"), labels, bound=bound)


def judged(docs: DataFrame, labels: DataFrame, model_path: str, carry: list[str], lang: str) -> DataFrame:
    """:func:`scored` with floors learned from all texts of ``docs`` labelled clean; every text is measured once."""
    measured = stored(scored(docs, model_path, carry=carry), "measures")
    floors = floors_of(measured, labels, lang)

    @F.pandas_udf("boolean")
    def above(name: pd.Series, language: pd.Series, n: pd.Series, entropy: pd.Series) -> pd.Series:
        of = [floors.get((s, l)) or floors.get((s, None)) for s, l in zip(name, language)]
        return pd.Series([f is None or k < MIN_TOKENS or e >= f.least(k) for f, k, e in zip(of, n, entropy)], dtype=bool)

    return measured.withColumn("kept", F.col("kept") & above("script", F.col(lang).cast("string"), "n_tokens", "entropy"))


def within(name: str, n: int, per_token: float | None, share: float | None, entropy: float | None, bands: dict = BANDS,
           floor: Floor | None = None) -> bool:
    """The verdict: all measures lie in the script's bands, the entropy above the floor for so many tokens if there is one."""
    if not n:
        return False
    low, high, most, least = bands.get(name, bands["other"])
    if floor is not None and n >= MIN_TOKENS:
        least = max(least, floor.least(n))
    return low <= per_token <= high and share <= most and (n < MIN_TOKENS or entropy >= least)


SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                   + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("n_tokens", pa.int64()),
                      ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("entropy", pa.float64())])


def scored(docs: DataFrame, model_path: str, bands: dict = BANDS, carry: list[str] | None = None,
           floors: dict | None = None, lang: str | None = None) -> DataFrame:
    """Measures and verdict of each whole text; ``carry`` names further columns to keep beside them.

    ``floors``: from :func:`learn_floors`; ``lang`` names the carried column with the language, if there is one.
    """
    carry, floors = carry or [], floors or {}
    language = 1 + carry.index(lang) if lang else None
    model = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    key = zlib.crc32(model.value)
    new = [f for f in SCHEMA if f.name not in carry]
    kept_fields = docs.select(*carry).schema if carry else None
    rows_in, place = text_once(docs, carry)

    def run(batches):
        codec = piece_codec.load(key, lambda: model.value)
        fert = Fertility(codec)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                p = b.slice(at, ROWS)
                texts = [t or "" for t in p.column(place).to_pylist()]
                rows = {f.name: [] for f in SCHEMA}
                rows["doc_id"] = p.column(0)
                for _, buf, off in scan.pieces(p.column(place)):
                    w = scan.Words(buf, off)
                    chars = np.concatenate([[0], np.cumsum(w.word_bytes & scan.IS_START[buf])])
                    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
                    rows["word_chars"] += (chars[off[1:]] - chars[off[:-1]]).tolist()
                    rows["n_symbols"] += (symbols[off[1:]] - symbols[off[:-1]]).tolist()
                    rows["n_words"] += np.diff(w.first).tolist()
                    rows["n_repeat_words"] += [repeated_words(w.hashes[a:z]) for a, z in zip(w.first[:-1], w.first[1:])]
                langs = p.column(language).to_pylist() if language else [None] * len(texts)
                for t, words, repeats, l in zip(texts, rows["n_words"], rows["n_repeat_words"], langs):
                    rows["n_dup_lines"].append(duplicate_lines(t))
                    name, m = script(t), fert.measure(t)
                    failed = words < MIN_WORDS or 100 * repeats > 50 * words
                    rows["base_failed"].append(failed)
                    floor = floors.get((name, l)) or floors.get((name, None))
                    rows["kept"].append(not failed and within(name, *m, bands, floor))
                    rows["script"].append(name)
                    for c, v in zip(("n_tokens", "chars_per_token", "fallback_share", "entropy"), m):
                        rows[c].append(v)
                out = [p.column(1 + k) for k in range(len(carry))]
                out += [c if isinstance(c := rows[f.name], pa.Array) else pa.array(c, f.type) for f in new]
                yield pa.RecordBatch.from_arrays(out, names=[*carry, *[f.name for f in new]])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields or []] + [f"{f.name} {kinds[f.type]}" for f in new]
    return rows_in.mapInArrow(run, ", ".join(ddl))
