"""Site-relative line deduplication with DataFrame functions only.

A line is boilerplate on a host if it stands on at least ``min_pages`` of its pages and on more than ``max_ratio`` of them.
Lines are counted once a page, by a 64-bit hash, with partial sums before the shuffle.  A host has at most
``mean lines a page / max_ratio`` such lines, so its list is bounded whatever its number of pages; hosts without any have
no row.  With ``by_length`` the ratio falls with the length of the line: it holds for lines of ``TYPICAL`` characters,
shorter ones need more and longer ones less, down to ``LEAST_RATIO``, which then bounds the list.  The pages are then read again and their lines filtered against the list of their host.

Edge cases: null texts stay null with no lines; blank lines are never dropped; pages without a host belong to no site and
stay as they are; repeated rows count as pages of their own; an empty table gives no rows; other columns pass through,
save that ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import stored

MAX_RATIO = 0.08
MIN_PAGES = 5
TYPICAL = 40                # characters of a line that max_ratio is meant for
LEAST_RATIO, MOST_RATIO = 0.02, 0.5
_HOST, _LIST, _HASH, _N = "__site_host", "__site_lines", "__line_hash", "__pages"
_CHARS = "__line_chars"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(pages: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO,
                      min_pages: int = MIN_PAGES, by_length: bool = False) -> DataFrame:
    """(host, hash, n, pages): lines over the ratio."""
    p = pages.select(F.col(host).alias(_HOST), F.col(text).alias("__text")).where(F.col(_HOST).isNotNull())
    totals = p.groupBy(_HOST).agg(F.count(F.lit(1)).alias(_N))
    full = F.filter(_lines(F.col("__text")), lambda x: F.trim(x) != "")
    once = F.explode(F.array_distinct(F.transform(full, lambda x: F.xxhash64(x))))
    ratio = F.lit(max_ratio)
    if by_length:
        once = F.explode(F.array_distinct(F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(F.trim(x)).alias("c")))))
        lines = p.select(_HOST, once.alias("l")).select(_HOST, F.col("l.h").alias(_HASH), F.col("l.c").alias(_CHARS))
        counts = lines.groupBy(_HOST, _HASH).agg(F.count(F.lit(1)).alias("n"), F.min(_CHARS).alias(_CHARS))
        ratio = F.least(F.lit(MOST_RATIO), F.greatest(F.lit(LEAST_RATIO), ratio * TYPICAL / F.col(_CHARS)))
    else:
        counts = p.select(_HOST, once.alias(_HASH)).groupBy(_HOST, _HASH).agg(F.count(F.lit(1)).alias("n"))
    return (counts.where(F.col("n") >= min_pages).join(totals, _HOST)
            .where(F.col("n") > ratio * F.col(_N)).select(_HOST, _HASH, "n", _N))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, by_length: bool = False) -> DataFrame:
    """All rows and columns with boilerplate lines taken out of the text; adds n_lines and n_dropped."""
    found = boilerplate_lines(pages, host, text, max_ratio, min_pages, by_length)
    lists = stored(found.groupBy(_HOST).agg(F.collect_set(_HASH).alias(_LIST)), "site-lines")
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    lines = _lines(F.col(text))
    kept = F.when(F.col(_LIST).isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(_LIST), F.xxhash64(x))))
    return (pages.join(lists, pages[host] == lists[_HOST], "left").withColumn("__kept", kept)
            .select(*[F.array_join("__kept", "\n").alias(text) if c == text else F.col(c) for c in columns],
                    F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped")))
