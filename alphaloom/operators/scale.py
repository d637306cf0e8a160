"""Skew-proof building blocks used by the cross-sectional operators.

A cross-section (one date) can hold any number of tickers, so nothing here
sorts or collects a whole cross-section in one task.  Statistics are two-phase
aggregates (map-side combine) joined back; ranks and order statistics come from
counts of distinct values, running inside ranges of values and shifted by the
counts of lower ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.storage import materialize


FEW_ROWS = 100_000


def handed_out(stats: DataFrame, label: str = "stats") -> DataFrame:
    """The rows, written, and broadcast if they are few, whatever the threshold for tables."""
    stats = materialize(stats, label)
    return F.broadcast(stats) if stats.limit(FEW_ROWS + 1).count() <= FEW_ROWS else stats


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics (one row per group) back to the rows.

    The statistics are written first, so that their size is known: ``FEW_ROWS`` at most are broadcast, which leaves the rows
    where they are; of more the planner decides, and shuffles and splits skewed partitions beyond its threshold.
    """
    return df.join(handed_out(stats), keys, how)


def ordered_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and distinct value: ``__c`` rows, ``__before`` rows with smaller values, ``__n`` rows in the group.

    One range-partitioned pass for all groups.  Equal values are counted before they are shuffled; the distinct values are
    dealt by range of (group, value), counted up inside each partition of a group and shifted by the rows of the group's
    earlier partitions.  Exact wherever the ranges are cut, and no task sorts a whole group.  The dealt values are written,
    so that both readers see the same cuts.  Stack columns (a further key) to rank several in the same pass.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    dealt = materialize(vals.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()), "values")
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("__pc"))
    group = W.partitionBy(*keys)
    offsets = sizes.select(*keys, "__part", (F.sum("__pc").over(group.orderBy("__part")) - F.col("__pc")).alias("__off"), F.sum("__pc").over(group).alias("__n"))
    inside = F.sum("__c").over(W.partitionBy(*keys, "__part").orderBy(value)) - F.col("__c")
    # both sides are partitioned by group and part: only the few offsets move
    return (dealt.withColumn("__in", inside).join(offsets, [*keys, "__part"])
            .select(*keys, value, "__c", (F.col("__off") + F.col("__in")).alias("__before"), "__n"))


def percentiles_of(o: DataFrame, keys: list[str], value: str, ps: dict[str, float], *more: Column) -> DataFrame:
    """Linear-interpolated percentiles per group of ordered counts: ``keys + list(ps)``, and further aggregates."""
    out = []
    for n, p in ps.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__c")), F.col(value)))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        out.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(n))
    return o.groupBy(*keys).agg(*out, *more)


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group: ``keys + list(ps)``."""
    return percentiles_of(ordered_counts(df.select(*keys, F.col(value).cast("double").alias("__v")), keys, "__v"), keys, "__v", ps)


PIVOT_ROWS = 2048       # rows of a group from which the brackets of its percentiles are taken
WHOLE_ROWS = 4096       # a group of so many rows at most is ordered at once


def wide_percentiles(df: DataFrame, keys: list[str], by: str, wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact linear-interpolated percentiles of several columns per group: ``keys``, ``__rows``, and a column for each name.

    ``wanted``: column -> {name: p}.  ``by`` is spread evenly by its hash (a ticker).  Groups of at most ``WHOLE_ROWS`` rows are
    ordered by one aggregate.  Of larger ones only the values near a percentile are dealt: some rows, chosen by hash, give a
    bracket around it, all rows are counted against the bracket, and the values inside are ordered.  Counts say whether a
    bracket holds its percentile; where one does not, the group's values are ordered whole (``ordered_counts``).  So the
    chosen rows only say where to look, and the result does not depend on them.
    """
    cuts = [(i, c, n, p) for i, (c, n, p) in enumerate((c, n, p) for c, names in wanted.items() for n, p in names.items())]
    sizes = handed_out(df.groupBy(*keys).agg(F.count("*").alias("__rows")), "sizes")
    rows = df.join(sizes, keys)
    share = F.when(F.col("__rows") <= WHOLE_ROWS, 1.0).otherwise(F.lit(float(PIVOT_ROWS)) / F.col("__rows"))
    some = rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 20)) < share * (1 << 20))
    off = lambda p: 5 * (p * (1 - p) / PIVOT_ROWS) ** 0.5  # noqa: E731  (five deviations of a rank)
    at = lambda c, p: F.percentile(c, F.array(*[F.lit(x) for x in (max(p - off(p), 0.0), p, min(p + off(p), 1.0))])).alias
    small = F.col("__rows") <= WHOLE_ROWS
    found = materialize(sizes.join(some.groupBy(*keys).agg(*[at(c, p)(f"__p{i}") for i, c, _, p in cuts]), keys, "left"), "pivots")
    whole = found.where(small).select(*keys, "__rows", *[F.col(f"__p{i}")[1].alias(n) for i, _, n, _ in cuts])
    if not found.where(~small).limit(1).count():
        return whole

    side = found.where(~small).select(*keys, *[F.col(f"__p{i}")[j].alias(f"__{e}{i}") for i, *_ in cuts for j, e in ((0, "a"), (2, "z"))])
    large = df.join(handed_out(side, "brackets"), keys)
    lo, hi = (lambda i: F.col(f"__a{i}")), (lambda i: F.col(f"__z{i}"))
    below = large.groupBy(*keys).agg(*[f.alias(f"__{e}{i}") for i, c, *_ in cuts for e, f in (("b", F.count_if(F.col(c) < lo(i))), ("n", F.count(c)))])
    long = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(p).alias("__p"), F.col(f"__b{i}").alias("__b"), F.col(f"__n{i}").alias("__n")) for i, _, _, p in cuts])).alias("__s"))
    near = large.select(*keys, F.explode(F.array_compact(F.array(*[
        F.when((F.col(c) >= lo(i)) & (F.col(c) <= hi(i)), F.struct(F.lit(i).alias("__i"), F.col(c).cast("double").alias("__v"))) for i, c, *_ in cuts]))).alias("__s"))
    got = _located(ordered_counts(near.select(*keys, "__s.*"), [*keys, "__i"], "__v").withColumnRenamed("__n", "__inside"), long.select(*keys, "__s.*"), keys)
    got = materialize(got, "cuts")
    lost = got.where("not __held").select(*keys, "__i")
    if lost.limit(1).count():
        every = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(c).cast("double").alias("__v")) for i, c, *_ in cuts])).alias("__s"))
        of = every.select(*keys, "__s.*").join(lost, [*keys, "__i"], "left_semi")
        whole_n = ordered_counts(of, [*keys, "__i"], "__v").withColumnRenamed("__n", "__inside")
        zero = long.select(*keys, "__s.*").join(lost, [*keys, "__i"], "left_semi").withColumn("__b", F.lit(0).cast("long"))
        got = got.where("__held").unionByName(_located(whole_n, zero, keys))
    out = got.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(n) for i, _, n, _ in cuts]).join(sizes, keys)
    return whole.unionByName(out.select(*whole.columns))


def _located(o: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __i, __q, __held): the percentile __p of __n values, of which __b lie below the ordered ones of ``o``."""
    x = targets.join(o, [*keys, "__i"], "left")
    pos = (F.col("__n") - 1) * F.col("__p")
    first = F.col("__b") + F.col("__before")
    at = lambda k: F.max(F.when((first <= k) & (k < first + F.col("__c")), F.col("__v")))
    g = x.groupBy(*keys, "__i").agg(at(F.floor(pos)).alias("__l"), at(F.ceil(pos)).alias("__h"), F.max(pos - F.floor(pos)).alias("__f"), F.max("__n").alias("__n"))
    held = (F.col("__l").isNotNull() & F.col("__h").isNotNull()) | (F.col("__n") == 0)
    return g.select(*keys, "__i", (F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("__f")).alias("__q"), held.alias("__held"))


def clipped_moments(df: DataFrame, keys: list[str], value: str, lower: float, upper: float, clip: Column | None = None) -> DataFrame:
    """Per group the cuts ``__lo`` and ``__hi``, and mean ``__m`` and population deviation ``__s`` of the clipped values.

    All from one ordered pass: the moments are taken over distinct values with their counts.  ``clip`` (over the keys) says
    which groups are clipped at all.
    """
    o = ordered_counts(df.select(*keys, F.col(value).cast("double").alias("__v")), keys, "__v")
    cuts = percentiles_of(o, keys, "__v", {"__lo": lower, "__hi": upper}, F.min("__v").alias("__least"))
    if clip is not None:
        cuts = cuts.withColumns({c: F.when(clip, F.col(c)) for c in ("__lo", "__hi")})
    # counted from the lower cut, squares stay exact enough to be taken in the same aggregate as the mean
    x = o.join(cuts.withColumn("__base", F.coalesce("__lo", "__least")), keys)
    d = bounded(F.col("__v")) - F.col("__base")
    n = F.sum("__c")
    g = x.groupBy(*keys).agg(F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"), F.first("__base").alias("__base"), (F.sum(F.col("__c") * d) / n).alias("__d"),
                             (F.sum(F.col("__c") * d * d) / n).alias("__dd"))
    return g.select(*keys, "__lo", "__hi", (F.col("__base") + F.col("__d")).alias("__m"), F.sqrt(F.greatest(F.col("__dd") - F.col("__d") * F.col("__d"), F.lit(0.0))).alias("__s"))


def bounded(v: Column) -> Column:
    """A value within its group's cuts, where it has any."""
    return F.when(v < F.col("__lo"), F.col("__lo")).when(v > F.col("__hi"), F.col("__hi")).otherwise(v)


def grouped_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank",
                  count_out: str | None = None) -> DataFrame:
    """Append the average (tie-shared) ascending rank of ``value`` in its group."""
    ranks = ordered_counts(df, keys, value).select(
        *keys, value, (F.col("__before") + (F.col("__c") + 1) / 2.0).alias(out), *([F.col("__n").alias(count_out)] if count_out else []))
    return df.join(ranks, keys + [value], "left")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per group; Spark prunes to n per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
