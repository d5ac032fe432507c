"""Exceedance counts and scenario curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow import config as C

#: Levels of one block of the running count.
BLOCK = 4096


def range_count(levels: DataFrame, thresholds: DataFrame, level: str = "level", threshold: str = "threshold", out: str = "n_at_or_above", count: str | None = None) -> DataFrame:
    """For each integer threshold, how many levels are at least as high; no inequality join. ``count``: a column that says how many a row stands for.

    Equal levels are counted first. The counts then run down within blocks of
    levels, and over the blocks' totals, so no task sees all levels.
    """
    block = F.floor(F.col("x") / BLOCK)
    have = levels.where(F.col(level).isNotNull()).groupBy(F.col(level).cast("long").alias("x")).agg((F.sum(count) if count else F.count("*")).alias("c")).withColumn("ask", F.lit(False))
    ask = thresholds.select(F.col(threshold).cast("long").alias("x")).distinct().select("x", F.lit(0).cast("long").alias("c"), F.lit(True).alias("ask"))
    rows = have.unionByName(ask).withColumn("block", block)
    totals = rows.groupBy("block").agg(F.sum("c").alias("total"))
    above = totals.select("block", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = Window.partitionBy("block").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("n", F.sum("c").over(inside)).where("ask").join(above, "block").select(F.col("x").alias("__x"), (F.col("n") + F.col("above")).cast("long").alias(out))
    return thresholds.join(counted, F.col(threshold).cast("long") == F.col("__x")).drop("__x")


def annual_count(n: Column, total: Column, per_year: int = C.TIDES_PER_YEAR) -> Column:
    """Expected exceedances a year in hundredths: the share of all, at most every one."""
    return F.least(F.lit(per_year * 100), F.rint(n * (per_year * 100.0) / total).cast("int"))


def year_curve(points: DataFrame, years: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Linear between known years, constant beyond them. ``points``: keys, year, value; ``years``: year."""
    w = Window.partitionBy(*keys).orderBy("year")
    spans = points.select(*keys, F.col("year").alias("y0"), F.col(value).alias("v0"), F.lead("year").over(w).alias("y1"), F.lead(value).over(w).alias("v1"), F.row_number().over(w).alias("nth"))
    # The known years of a curve are few; each is spread over the years up to the next.
    lo, hi = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi")), None
    spread = spans.crossJoin(F.broadcast(lo)).select(*keys, "y0", "v0", "y1", "v1", F.explode(F.sequence(F.when(F.col("nth") == 1, F.least("lo", "y0")).otherwise(F.col("y0")), F.coalesce(F.col("y1") - 1, F.greatest("hi", "y0")))).alias("year"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    shown = F.when((F.col("year") <= F.col("y0")) | F.col("y1").isNull(), F.col("v0")).otherwise(line)
    return spread.join(years, "year", "left_semi").select(*keys, "year", shown.alias(value))


def deltas_from(curve: DataFrame, keys: list[str], base_year: int, value: str = "value") -> DataFrame:
    base = curve.where(F.col("year") == base_year).select(*keys, F.col(value).alias("__base"))
    return curve.join(base, keys).withColumn("delta", F.col(value) - F.col("__base")).drop("__base")


def exceedance_cube(levels: DataFrame, curve: DataFrame, elevations: DataFrame, total: int | Column) -> DataFrame:
    """Annual counts for every scenario, elevation and year: levels over the elevation less the rise, all in hundredths."""
    grid = curve.select("scenario", "year", "delta_c").crossJoin(F.broadcast(elevations.select("elev_c")))
    asked = grid.withColumn("threshold", F.col("elev_c") - F.col("delta_c"))
    return range_count(levels, asked).withColumn("annual_c", annual_count(F.col("n_at_or_above"), F.lit(total) if isinstance(total, int) else total))


def ranked(df: DataFrame, least: float, height: str, *ties: str) -> DataFrame:
    """Rows from the least height on, the highest first; a total order when ``ties`` make one."""
    return df.where(~F.isnan(F.col(height)) & (F.col(height) >= least)).orderBy(F.desc(height), *ties)
