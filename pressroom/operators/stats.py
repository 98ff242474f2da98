"""Corpus statistics (G1-G8): describe, equal-width histograms, yearly counts,
grouping sets, rollups and stage comparisons.

Scale notes
-----------
* ``percentile`` buffers every value of a group in one task, which fails when
  one site holds a third of the corpus.  Quartiles here are exact but built
  from a *value-count* table ``(group, value, c)``: partial aggregation folds
  rows map-side, so a group's size is its number of distinct values (bounded
  by the value range), never its number of rows.  A running sum over that
  table locates the ranks needed for linear interpolation (pandas/numpy
  ``linear``, DuckDB ``quantile_cont``).
* Histograms reuse the same value-count table, so raw rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.text import round4

QUANTILES = ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
TOTAL = "__all__"  # group label of the overall row in rollups


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, c): rows folded per distinct value (partial aggregation)."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")))


def _rollup_counts(vc: DataFrame, value: str, key: str) -> DataFrame:
    """Add an overall group (``key = TOTAL``) to a value-count table."""
    total = vc.groupBy(value).agg(F.sum("c").alias("c")).select(F.lit(TOTAL).alias(key), value, "c")
    return vc.select(F.col(key).cast("string").alias(key), value, "c").unionByName(total)


def describe_counts(vc: DataFrame, value: str, by: list[str]) -> DataFrame:
    """pandas ``describe`` from a value-count table.

    count, mean, std (n-1), min, 25/50/75 % (linear), max.  count, min,
    quartiles and max are truncated to integers as the reference does with
    ``astype(int)``; mean and std are rounded to 4 digits.
    """
    x = F.col(value).cast("double")
    moments = vc.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.sum(x * F.col("c")).alias("s1"),
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"))
    # running rank range of each distinct value: rows [cum - c, cum - 1]
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = vc.withColumn("cum", F.sum("c").over(w))
    j = ranked.join(moments, by)
    mean = F.col("s1") / F.col("n")
    aggs = [F.first("n").alias("n"), F.first("s1").alias("s1"),
            F.first("vmin").alias("vmin"), F.first("vmax").alias("vmax"),
            # sum of squared deviations from the exact mean: no cancellation
            F.sum(F.col("c") * F.pow(x - mean, 2)).alias("m2")]
    for q, name in QUANTILES:
        pos = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        in_lo = (F.col("cum") > lo) & (F.col("cum") - F.col("c") <= lo)
        in_hi = (F.col("cum") > hi) & (F.col("cum") - F.col("c") <= hi)
        aggs += [F.max(F.when(in_lo, x)).alias(f"{name}_lo"),
                 F.max(F.when(in_hi, x)).alias(f"{name}_hi"),
                 F.first(pos - lo).alias(f"{name}_f")]
    g = j.groupBy(*by).agg(*aggs)
    out = [F.col(b) for b in by] + [
        F.col("n").cast("long").alias("count"),
        round4(F.col("s1") / F.col("n")).alias("mean"),
        round4(F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))).alias("std"),
        F.col("vmin").cast("long").alias("min")]
    for _, name in QUANTILES:
        v = F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_f")
        out.append(v.cast("long").alias(name))
    out.append(F.col("vmax").cast("long").alias("max"))
    return g.select(*out)


def describe(df: DataFrame, value: str, by: str | list[str] = "domain") -> DataFrame:
    """Describe ``value`` per group."""
    by = [by] if isinstance(by, str) else list(by)
    return describe_counts(value_counts(df, value, by), value, by)


def describe_rollup(df: DataFrame, value: str, key: str = "site") -> DataFrame:
    """Describe per ``key`` and overall (``key = '__all__'``) in one plan."""
    vc = _rollup_counts(value_counts(df, value, [key]), value, key)
    return describe_counts(vc, value, [key])


def histogram_counts(vc: DataFrame, value: str, by: list[str], bins: int = 100) -> DataFrame:
    """Equal-width bins between each group's min and max; last bin closed.

    Bin index is integer arithmetic, ``(x - min) * bins div (max - min)``, so no
    floating-point edge case decides a boundary row.
    """
    keys = by or ["_all"]
    if not by:  # one overall group: its range is a single row, broadcast by construction
        vc = vc.withColumn("_all", F.lit(0))
    rng = vc.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = vc.join(rng if by else F.broadcast(rng), keys)
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) * bins / width), F.lit(bins - 1)))
    return (j.withColumn("bin", b.cast("int"))
            .groupBy(*by, "bin")
            .agg(F.sum("c").cast("long").alias("n"),
                 F.first("lo").alias("lo"), F.first("hi").alias("hi"))
            .select(*by, "bin",
                    round4(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_start"),
                    round4(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins).alias("bin_end"),
                    "n"))


def histogram(df: DataFrame, value: str, by: str | list[str] | None = "site",
              bins: int = 100) -> DataFrame:
    """G3 (per site) / G4 (``by=None``: all sites together)."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return histogram_counts(value_counts(df, value, by), value, by, bins)


def yearly_counts(df: DataFrame, date_col: str = "date_of_creation", id_col: str = "uuid",
                  year_max: int = 2023, by: list[str] | None = None) -> DataFrame:
    """Articles per year, undated rows dropped, year <= ``year_max``.

    ``count(id)`` like the reference's ``groupby('year')['uuid'].count()``.
    """
    by = by or []
    y = F.year(F.col(date_col))
    return (df.where(F.col(date_col).isNotNull() & (y <= year_max))
            .groupBy(y.cast("long").alias("year"), *by)
            .agg(F.count(id_col).alias("n")))


def yearly_counts_grouping_sets(df: DataFrame, group_col: str, date_col: str = "date_of_creation",
                                id_col: str = "uuid", year_max: int = 2023) -> DataFrame:
    """The same yearly count overall and per group (e.g. language) in one
    aggregation: ``GROUPING SETS ((year), (year, group))``.  The overall rows
    carry ``group = '__all__'``."""
    y = F.year(F.col(date_col))
    base = (df.where(F.col(date_col).isNotNull() & (y <= year_max))
            .select(y.cast("long").alias("year"), F.col(group_col).cast("string").alias(group_col), F.col(id_col)))
    g = base.groupingSets([["year"], ["year", group_col]], "year", group_col) \
        .agg(F.count(id_col).alias("n"), F.grouping(group_col).alias("_g"))
    return g.select("year",
                    F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(group_col)).alias(group_col),
                    "n")


def stage_compare(stages: dict[str, DataFrame], value: str, by: str = "domain") -> DataFrame:
    """Describe of several stages (e.g. raw and clean) side by side.

    Stages are tagged and unioned *after* folding to value counts, so the
    raw rows of each stage are scanned once and never unioned whole.
    """
    vcs = None
    for name, df in stages.items():
        vc = value_counts(df, value, [by]).withColumn("stage", F.lit(name))
        vcs = vc if vcs is None else vcs.unionByName(vc)
    return describe_counts(vcs, value, ["stage", by])


def col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
