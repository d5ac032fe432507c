"""Data-quality assertions: each returns the rows that break it, and must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow.operators import raster


def histogram_totals(zones: DataFrame) -> DataFrame:
    """Zones whose histogram does not sum to their cells."""
    return zones.where(F.aggregate("hist", F.lit(0).cast("bigint"), lambda s, x: s + x) != F.col("cell_count"))


def mixed_hard_zones(zones: DataFrame) -> DataFrame:
    return zones.where((F.col("hard_cells") > 0) & (F.col("hard_cells") != F.col("cell_count")))


def low_hard_cells(cells: DataFrame, floor: int = C.HARD_MIN_D) -> DataFrame:
    return cells.where(F.col("hard") & (F.col("elev").isNull() | (F.col("elev") < floor)))


def low_hard_edges(edges: DataFrame, zones: DataFrame, floor: int = C.HARD_MIN_D) -> DataFrame:
    """Edges of a hard zone whose crest is below the wall."""
    hard = zones.where("hard_cells > 0").select(F.col("zone_id").alias("z"))
    low = edges.where(F.col("crest") < floor)
    return low.join(hard, low["zone_a"] == hard["z"], "left_semi").unionByName(low.join(hard, low["zone_b"] == hard["z"], "left_semi")).distinct()


def thin_walls(centre: DataFrame, mask: DataFrame, offsets: tuple[int, ...] = (0, 1, 5, 10)) -> DataFrame:
    """Centreline cells, shifted along the axes, that the wall does not cover."""
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for o in offsets for dy, dx in ((o, 0), (-o, 0), (0, o), (0, -o))))
    moved = centre.select("y", "x", F.explode(F.array_distinct(steps)).alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return moved.join(mask, ["y", "x"], "left_anti")


def unequal_phases(states: DataFrame) -> DataFrame:
    """Stages and zones whose surface is not the same in all phases."""
    each = states.groupBy("stage_c", "zone_id").agg(F.min("surface_c").alias("lowest"), F.max("surface_c").alias("highest"), F.count("surface_c").alias("filled"), F.count("*").alias("rows"))
    return each.where("lowest <> highest or (filled > 0 and filled < rows)")


def mask_mismatch(depth: DataFrame, stage: DataFrame) -> DataFrame:
    """Cells that only one of two masks has."""
    a, b = depth.select("y", "x", F.lit(1).alias("a")), stage.select("y", "x", F.lit(1).alias("b"))
    return a.join(b, ["y", "x"], "full").where("a is null or b is null").select("y", "x")


def unseeded(wet: DataFrame, source: str) -> DataFrame:
    """Wet components without a source cell, or of one cell."""
    named = raster.components(wet)
    return named.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(source).alias("seeded")).where("not seeded or n < 2")


def summary(**found: DataFrame) -> DataFrame:
    """One row: the number of breaking rows of each assertion."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in found.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)
