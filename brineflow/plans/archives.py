"""Archives from gauges: compact and hourly days, forecasts, crest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow.functions import levels as L
from brineflow.operators import series


def civil_days(samples: DataFrame, zone: str) -> DataFrame:
    """``series, d``: every civil day from a series' first sample to its last."""
    ends = samples.groupBy("series").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ends.select("series", F.explode(F.sequence(L.civil_day(F.col("lo"), zone), L.civil_day(F.col("hi"), zone))).alias("d"))


def clipped_days(days: DataFrame, first, cutoff) -> DataFrame:
    """The days from ``first`` to the one before ``cutoff``; a start that is not before the cutoff is an error."""
    if first >= cutoff:
        raise ValueError(f"the start {first} is not before {cutoff}")
    return days.where(F.col("d").between(F.lit(first), F.date_sub(F.lit(cutoff), 1)))


def civil_slots(days: DataFrame, zone: str, step_s: int = 900) -> DataFrame:
    """``d, u, pos, t`` and what else ``days`` has: the slots of each civil day (92, 96 or 100 quarter-hours), ``u`` its first instant."""
    bounds = days.withColumns({"u": L.civil_midnight(F.col("d"), zone), "__end": L.civil_midnight(F.date_add("d", 1), zone)})
    return bounds.select(*days.columns, "u", F.posexplode(F.sequence("u", F.col("__end") - step_s, F.lit(step_s))).alias("pos", "t"))


def compact_days(samples: DataFrame, days: DataFrame | None = None, zone: str = "America/New_York") -> DataFrame:
    """Quarter-hour rows of each series and civil day with a level: ``v`` in hundredths, peak ``p`` and class ``c``.

    ``days``: the same days for all series; by default each series' own, from its first sample to its last.
    """
    at = civil_slots(civil_days(samples, zone) if days is None else samples.select("series").distinct().crossJoin(days), zone)
    filled = at.join(series.interpolate(samples, at.select("series", "t").distinct()), ["series", "t"], "left").withColumn("x", L.centi(F.col("v")))
    rows = series.compact(filled, ["series", "d", "u"], "pos", "x")
    peak = F.array_max("v")
    return rows.where(peak.isNotNull()).withColumns({"p": peak, "c": L.classify(peak / 100)})


def hourly_days(hours: DataFrame, slots: DataFrame, fills: DataFrame) -> DataFrame:
    """Hourly rows (series, t, x in hundredths) as days with a level: ``v``, peak, class, and ``x``, the positions that ``fills`` (series, anchor) gave."""
    at = hours.select("series", "t", F.col("x").alias("level"))
    days = series.compact(slots.join(at, ["series", "t"], "left"), ["series", "d", "u"], "pos", "level")
    peak = F.array_max("v")
    return fill_flags(days.where(peak.isNotNull()).withColumns({"p": peak, "c": L.classify(peak / 100)}), fills)


def peak_or(hourly: Column, quarter: Column) -> Column:
    """A day's peak by its hours, or by its quarter-hours where no hour has a level."""
    return F.coalesce(hourly, quarter)


def hourly_rows(samples: DataFrame, slots: DataFrame) -> DataFrame:
    """The largest observation of each hour slot (first on ties), with phases within the day and the level over the other datum."""
    hours = slots.select("d", "pos", F.col("t").alias("hour"))
    seen = samples.withColumn("hour", F.floor(F.col("t") / 3600) * 3600).join(hours, "hour")
    best = series.arg_max(seen, ["series", "hour"], "v", "t")
    best = best.withColumn("navd_c", F.rint((F.col("v") + 1e-9) * 100).cast("int")).withColumn("mllw_c", L.to_mllw_c(F.col("navd_c")))
    return best.withColumn("phase", series.phase("navd_c", ["series", "d"], ["hour"], C.PHASE_EPSILON_FT * 100))


def forecast_rows(hours: DataFrame) -> DataFrame:
    """Forecast hours (name, pos, mllw) with stage, key, clamp flag, phase and rise by array position."""
    navd = L.half_up_2(F.col("mllw") + C.MLLW_OFFSET_FT)
    rows = hours.withColumn("navd", navd).withColumns({"stage_key": L.stage_key(F.col("navd")), "clamped": L.clamped(F.col("navd")), "c": L.centi(F.col("navd"))})
    return rows.withColumns({"phase": series.phase("c", ["name"], ["pos"], C.PHASE_EPSILON_FT * 100), "rise": series.rise_rate("navd", ["name"], ["pos"])}).drop("c")


def rederived(days: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Days with the arrays of ``overlay`` (d, v, s) where it has them, and peak and class anew."""
    if overlay is not None:
        days = days.join(overlay.withColumnsRenamed({"v": "v2", "s": "s2"}), "d", "left").withColumns({"v": F.coalesce("v2", "v"), "s": F.coalesce("s2", F.col("s") if "s" in days.columns else F.lit(None))}).drop("v2", "s2")
    peak = F.array_max("v")
    return days.withColumns({"p": peak, "c": L.classify(peak / 100)})


def crest_rows(records: DataFrame, least_ft: float = C.FLOOD_FT["minor"]) -> DataFrame:
    """Crests of a peak feed: the first filled of two dates, heights and times, from the least height on."""
    height = F.coalesce(F.col("ag_gage_ht").try_cast("double"), F.col("gage_ht").try_cast("double"))
    when = L.first_filled(F.col("ag_dt"), F.col("peak_dt"))
    rows = records.select(L.finite(height).alias("height_ft"), F.try_to_date(when).alias("date"), L.normalize_time(L.first_filled(F.col("ag_tm"), F.col("peak_tm"))).alias("time_est"))
    return rows.where((F.col("height_ft") >= least_ft) & F.col("date").isNotNull()).withColumn("display_date", L.display_date(F.col("date")))


def crest_table(parsed: DataFrame, manual: DataFrame, excluded_date, area: str = "calibrated") -> DataFrame:
    """Manual and parsed crests, without the excluded date's but for the calibrated one's, the highest first."""
    rows = manual.unionByName(parsed, allowMissingColumns=True)
    keep = (F.col("date") != F.lit(excluded_date)) | F.coalesce(F.col("source_area") == area, F.lit(False))
    ties = [F.desc("height_ft"), F.col("date"), F.desc_nulls_last("station_priority")]
    return rows.where(F.coalesce(keep, F.lit(True))).orderBy(*ties)


def missing_months(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Months that hold an expected hour which is not there: what has to be fetched again."""
    gone = series.missing(expected, present, ["hour"])
    return gone.select(F.trunc(F.timestamp_seconds(F.col("hour") * 3600).cast("date"), "month").alias("month")).distinct()


def fill_flags(days: DataFrame, fills: DataFrame) -> DataFrame:
    """Add ``x`` to compact hourly days (series, d, u, v): the positions that were filled from the finer feed."""
    at = fills.select("series", "anchor").distinct()
    slots = days.select("series", "d", F.posexplode(F.transform("v", lambda _, i: F.col("u") + i * 3600)).alias("pos", "anchor"))
    x = slots.join(at, ["series", "anchor"], "left_semi").groupBy("series", "d").agg(F.array_sort(F.collect_list("pos")).alias("x"))
    return days.join(x, ["series", "d"], "left")


def quality(days: DataFrame) -> DataFrame:
    """One row: first and last day, filled and all slots."""
    return days.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.sum(F.size(F.array_compact("v"))).alias("n_filled"), F.sum(F.size("v")).alias("n_slots"))


def latest_first(days: DataFrame, n: int) -> DataFrame:
    return days.orderBy(F.desc("d")).limit(n)


def lagged_range(days: DataFrame, back_days: int = 3) -> DataFrame:
    """Where each series' incremental run starts again: some days before the last one archived."""
    return days.groupBy("series").agg(F.date_sub(F.max("d"), back_days).alias("start"))


def windowed_phase(days: DataFrame) -> DataFrame:
    """Exploded slots with their phase; the first and last slot of a day have one neighbour."""
    rows = days.select("series", "d", F.posexplode("v").alias("pos", "x")).where("x is not null")
    return rows.withColumn("phase", series.phase("x", ["series", "d"], ["pos"], C.PHASE_EPSILON_FT * 100))
