"""Registered queries of the operators, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import chat, collocations, fertility, jaccard, langid, line_dedup, nndescent, packing, piece_codec, prefix_trie, simhash, tokenfile, warc
from alphaloom.llm.common import read_table

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, host="source").select("doc_id", "text", "n_lines", "n_dropped")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), keep_ids=False)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(read_table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)
    return fertility.judged(docs, read_table(spark, sf_dir, "labels"), model, carry=["lang"], lang="lang")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.round_trip(turns, public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    profiles = langid.learn(docs.where(~out))
    return langid.identified(docs, profiles).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), keep_ids=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_piece_codec, op4_ngram_jaccard, op5_nearest, op6_fertility, op7_chat, op8_language, op9_packing, op10_token_files,
                                  op11_simhash, op12_prefix_trie, op13_collocations)}
SQL: dict[str, str] = {"op1_line_dedup": f"""
    with pages as (select row_number() over () as rid, doc_id, source, text, string_split(text, chr(10)) as lines from documents),
    lined as (select distinct rid, source, unnest(lines) as line from pages where source is not null),
    totals as (select source, count(*) as pages from documents where source is not null group by source),
    found as (select l.source, l.line from lined l join totals t on l.source = t.source where trim(l.line) <> ''
              group by l.source, l.line, t.pages having count(*) >= {line_dedup.MIN_PAGES} and count(*) > {line_dedup.MAX_RATIO}::double * t.pages),
    lists as (select source, list(line) as dropped from found group by source),
    kept as (select doc_id, lines, case when dropped is null then lines else list_filter(lines, lambda x: not list_contains(dropped, x)) end as rest
             from pages left join lists on pages.source = lists.source)
    select doc_id, array_to_string(rest, chr(10)) as text, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(rest), 0) as n_dropped from kept""",
    "op13_collocations": rf"""
    with texts as (select coalesce(lang, '{collocations.NO_LANGUAGE}') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    pieces as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts),
    runs as (select lang, list_slice(w, i, i + k - 1) as w, k from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), unnest(range(1, {collocations.LONGEST} + 1)) as t(k) where i + k - 1 <= len(w)),
    f as (select lang, w, k, count(*) as c from runs group by lang, w, k),
    totals as (select lang, sum(c) as n from f where k = 1 group by lang),
    cand as (select lang, w, k, c as a from f where k > 1 and c >= {collocations.LEAST}),
    inner_ as (select distinct lang, list_slice(w, i, i + j - 1) as w, a as m from (select lang, w, a, j, unnest(range(1, k - j + 2)) as i from (select lang, w, a, k, unnest(range(2, k)) as j from cand))),
    kept as (select c.* from cand c where not exists (select 1 from inner_ x where x.lang = c.lang and x.w = c.w and 100 * x.m >= 100 * c.a)),
    cuts as (select kept.lang, kept.w, a, n, p, l.c as l, r.c as r, (1000::hugeint * a * n) // (l.c::hugeint * r.c) as score from (select lang, w, a, k as len_w, unnest(range(1, k)) as p from kept) kept join totals on totals.lang = kept.lang
             join f l on l.lang = kept.lang and l.w = list_slice(kept.w, 1, p) join f r on r.lang = kept.lang and r.w = list_slice(kept.w, p + 1, len_w)),
    best as (select * from cuts qualify row_number() over (partition by lang, w order by score, p) = 1)
    select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from (
      select *, array_to_string(w, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(w, ' ')) as rank from best) where rank <= {collocations.TOP}"""}
