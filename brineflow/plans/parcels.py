"""Parcels against flood frequency: events, rebased counts, and each parcel's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import frequency, geometry, raster, series
from brineflow.operators.peaks import peak_events
from brineflow.operators.projection import TransverseMercator


def tide_events(samples: DataFrame, trend_ft_per_year: float, base_year: int = 2026) -> DataFrame:
    """High tides of each series: year, level in thousandths as single precision gives it, and the level rebased."""
    peaks = peak_events(samples, ["series"])
    year = F.year(F.timestamp_seconds("t"))
    level = F.col("v").cast("float").cast("double")
    return peaks.select("series", "t", year.alias("year"), F.rint(level * 1000).cast("int").alias("level_m"), series.rebase(level, year, trend_ft_per_year, base_year).alias("rebased"))


def record(events: DataFrame) -> DataFrame:
    """One row: events, distinct years, span in years (one at least) and the rate."""
    span = F.greatest(F.lit(1.0), (F.max("t") - F.min("t")) / (365.2425 * 86400))
    return events.agg(F.count("*").alias("n_events"), F.count_distinct("year").alias("n_years"), span.alias("span_years"), (F.count("*") / span).alias("per_year"))


def rise_curves(points: DataFrame, years: DataFrame, base_year: int = 2026) -> DataFrame:
    """Scenario rises from centimetres at known years: hundredths of a foot over the base year."""
    feet = points.select("scenario", "year", L.cm_to_ft(F.col("cm")).alias("value"))
    curve = frequency.deltas_from(frequency.year_curve(feet, years, ["scenario"]), ["scenario"], base_year)
    return curve.select("scenario", "year", F.rint(F.col("delta") * 100).cast("int").alias("delta_c"))


def nearest_step(model_c, step_c: int = C.STAGE_STEP_C):
    """Index of the nearest elevation on a grid of even steps from zero, the lower on a tie."""
    return F.ceil(F.lit(-0.5) + model_c / step_c).cast("int")


def enriched(parcels: DataFrame, cells: DataFrame, events: DataFrame, origin_x: float, origin_y: float, cell_ft: float, projection: TransverseMercator | None = None) -> DataFrame:
    """Parcels (``id`` and ``ring``, or ``parts`` with holes, in the grid's coordinates, or in degrees that ``projection`` takes there) with the ground at their centroid's nearest cell, its distance, and past and expected floods.

    Parcels without geometry, without area or without a cell near are left out; :func:`skipped` counts them.
    """
    # One file of many parcels is few tasks.
    spread = parcels.repartition("id")
    if "parts" in parcels.columns:
        at = geometry.polygon_centroids(spread.where("parts is not null"), "id", "parts")
    else:
        at = geometry.centroids(spread.where(F.size("ring") >= 4), "id", "ring")
    # Asked of the saved table: as a filter here the centres would be made before the parcels are dealt, and once more after it.
    at = runtime.save(at, "parcel-centres").where("cx is not null")
    x, y = (F.col("cx"), F.col("cy")) if projection is None else projection.forward(F.col("cx"), F.col("cy"))
    px, py = geometry.to_grid(x, y, origin_x, origin_y, cell_ft)
    near = raster.ring_nearest(at.select("id", py.alias("py"), px.alias("px")), cells, "id")
    ground = near.join(cells.select("y", "x", "elev"), ["y", "x"]).select("id", "radius", F.col("elev").alias("elev_d"))
    ground = ground.withColumn("model_c", F.least(F.lit(C.HIST_MAX_D * 10), F.greatest(F.lit(0), F.col("elev_d") * 10))).withColumn("grid_at", nearest_step(F.col("model_c")))
    ground = runtime.save(ground, "parcel-ground")
    levels = events.select(F.rint(F.col("rebased") * 100).cast("int").alias("level"))
    total = levels.agg(F.count("*").alias("total"))
    counted = frequency.range_count(levels, ground, "level", "model_c").crossJoin(F.broadcast(total))
    return counted.withColumn("annual_c", frequency.annual_count(F.col("n_at_or_above"), F.col("total"))).drop("total").join(parcels, "id")


def skipped(parcels: DataFrame, done: DataFrame) -> DataFrame:
    return parcels.agg(F.count("*").alias("n_all")).crossJoin(done.agg(F.count("*").alias("n_done"))).select("n_all", "n_done", (F.col("n_all") - F.col("n_done")).alias("n_skipped"))


def cube_document(cube: DataFrame) -> DataFrame:
    """Nested JSON: for each scenario the elevations in order, each with its years' counts in order; the cube is small by its grid."""
    years = cube.groupBy("scenario", "elev_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "annual_c"))), lambda s: s["annual_c"] / 100).alias("counts"), (F.sum("annual_c") / 100).alias("total"))
    rows = years.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("elev_c", "counts", "total"))).alias("elevations"))
    return rows.select(F.to_json(F.struct("scenario", "elevations", F.lit(C.TIDES_PER_YEAR).alias("tidesPerYear"))).alias("value"))
