"""From raw documents to packed training sequences, one operator a stage.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last returns packed
pieces.  Between stages the rows are written as Parquet in the shared folder and read again.  Rows with null or empty
texts fail the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import fertility, jaccard, langid, line_dedup, packing
from alphaloom.llm.common import read_table, stored
from alphaloom.llm.queries import PIECE_MODEL, WORD_VOCABULARY

WORD = r"[^\x20\x09-\x0D]"       # what a word is made of
MIN_LANGUAGE_SCORE = 0.25       # a text further from every language is of none of them


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The documents with their own columns under names that no operator uses, these names, and the way back."""
    names = {c: f"__own{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    moved = docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])
    return moved, moved.columns, lambda rows: rows.select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules, the fertility bands of their script and the entropy floors of their language.

    Floors are learned from all documents that the folder's ``labels`` call clean; without a folder the bands stand alone.
     Null and empty texts fail the rules; repeated rows are judged alike; a null lang takes its script's
    floor; own columns of any name stay as they are.
    """
    model = public_tokenizers.path(PIECE_MODEL)
    moved, own, back = _aside(docs)
    if not sf_dir:
        return back(fertility.scored(moved, model, carry=own).where("kept"))
    lang = own[docs.columns.index("lang")]
    return back(fertility.judged(moved, read_table(spark, sf_dir, "labels"), model, carry=own, lang=lang).where("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near to a language learned from the documents at hand; a null lang becomes the prediction.

    A given lang stays, whatever is predicted.  Null texts and texts without letters go; texts equally near to two
    languages get the first by name; repeated rows are judged alike; own columns of any name stay as they are.
    """
    moved, own, back = _aside(docs)
    found = langid.identified(moved, langid.learn(docs), carry=own)
    near = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    lang = own[docs.columns.index("lang")]
    return back(near.withColumn(lang, F.coalesce(lang, "lang_pred")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source and, by length, of its pages in their language."""
    kept = line_dedup.drop_boilerplate(docs, host="source")
    section = F.concat("source", F.lit("\n"), F.coalesce("lang", F.lit("")))
    kept = line_dedup.drop_boilerplate(kept.withColumn("__section", section), host="__section", by_length=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; documents without a doc_id stay.

    Rows count by a key of their own: of a repeated doc_id, rows go only if their texts are linked or equal.  Texts stay
    where they are: which rows go is one bit each, 64 rows a word, and words are few enough for Spark to broadcast; only
    texts without words are dealt anew.
    """
    keyed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    named = keyed.where("doc_id is not null")
    groups = stored(jaccard.near_duplicates(named.select(F.col("__row").alias("doc_id"), "text")), "groups")
    members = groups.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id").join(named.select("__row", "doc_id"), "__row")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("m"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = members.join(first, "component_id").where("__row <> m.__row").select(F.shiftright("__row", 6).alias("__word"), (F.col("__row") % 64).cast("int").alias("bit"))
    gone = stored(gone.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__gone")), "gone")
    bare = F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rest = keyed.where(~bare).withColumn("__word", F.shiftright("__row", 6)).join(gone, "__word", "left")
    rest = rest.where(F.coalesce(F.getbit("__gone", (F.col("__row") % 64).cast("int")), F.lit(0)) == 0)
    return rest.select(*docs.columns).unionByName(keyed.where(bare).dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences of several lengths."""
    return packing.packed(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("packing", packed_sequences),
]

ORACLE_SQL = None       # tokenisers and profiles are beyond SQL: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
