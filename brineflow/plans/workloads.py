"""The library's queries over the driver's tables, each with its SQL.

``events`` stands for gauges (``user_id`` names a series), ``orders`` for crest
records, ``embeddings`` for a raster (row ``vec_id``, column the position,
tenths of the value). Counts are BIGINT, levels whole hundredths or tenths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import frequency, geometry, hydraulics, peaks, raster, series, stages
from brineflow.plans import oracles
from brineflow.runtime import table

MINOR, MODERATE, MAJOR = 100.0, 200.0, 300.0


def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", L.epoch_s(F.col("ts")).alias("t"), "ts", F.col("value").alias("v"))


def _gauge(spark, d) -> DataFrame:
    e = _events(spark, d).withColumn("series", F.lit("all"))
    return series.dedupe(e, ["series", "t"], ["ts", "event_id"])


def gauge_dedupe_second(spark: SparkSession, d: str) -> DataFrame:
    return _gauge(spark, d).select("t", "v")


def _quarters(spark, d) -> DataFrame:
    g = _gauge(spark, d)
    days = g.groupBy("series").agg((F.floor(F.min("t") / 86400) * 86400).alias("lo"), ((F.floor(F.max("t") / 86400) + 1) * 86400).alias("hi"))
    at = series.anchors(days, 900)
    return series.interpolate(g, at).select("t", L.centi(F.col("v")).alias("level_c"))


def quarter_hour_interp(spark, d):
    return _quarters(spark, d)


def _day(t: str = "t"):
    return F.expr(f"cast(date_add(date'1970-01-01', cast({t} div 86400 as int)) as date)")


def daily_class(spark, d):
    q = _quarters(spark, d).groupBy(_day().alias("day")).agg(F.max("level_c").alias("peak_c"), F.count("level_c").alias("n_valid"), F.count("*").alias("n_slots"))
    return q.select("day", "peak_c", L.classify(F.col("peak_c") / 100.0, MINOR, MODERATE, MAJOR).alias("class"), "n_valid", "n_slots")


def hourly_argmax(spark, d):
    e = _events(spark, d).withColumn("hour", F.expr("t div 3600"))
    return series.arg_max(e, ["hour"], "v", "ts", "event_id").select("hour", "event_id", "v")


def _feeds(spark, d):
    """Every event in one of two feeds of its gauge: ``signup`` rows are hours already on record, all others are samples."""
    e = _events(spark, d).select(F.col("user_id").alias("series"), "t", "v", F.col("event_id").alias("ord"), F.col("event_type").eqNullSafe("signup").alias("on_record"))
    anchor = (F.rint(F.col("t") / 3600) * 3600).cast("long")
    return e.where("not on_record"), e.where("on_record").select("series", anchor.alias("anchor")).distinct()


def hour_anchor_nearest_fill(spark, d):
    samples, existing = _feeds(spark, d)
    return series.nearest_fill(samples, existing).select(F.col("series").alias("user_id"), "anchor", F.col("ord").alias("event_id"), "dist", "v")


def missing_anchors(spark, d):
    hour = _events(spark, d).select(F.expr("t div 3600").alias("hour"))
    expected = hour.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("hour"))
    return series.missing(expected, hour.distinct(), ["hour"]).select("hour", F.trunc(_day("(hour * 3600)"), "month").alias("month"))


def phase_per_user(spark, d):
    e = _events(spark, d).withColumns({"day": F.expr("t div 86400"), "c": L.centi(F.col("v"))})
    return e.select("event_id", series.phase("c", ["user_id", "day"], ["ts", "event_id"], 2.5).alias("phase"))


def rise_rate(spark, d):
    e = _events(spark, d).withColumn("c", L.centi(F.col("v")))
    return series.rises(e, "c", ["user_id"], ["ts", "event_id"], "rise_c").select("event_id", "rise_c")


def gap_sessions(spark, d):
    return series.sessions(_events(spark, d), ["user_id"], 6 * 3600, 2)


def local_maxima(spark, d):
    return series.local_maxima(_events(spark, d), "v", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "v")


def peak_events(spark, d):
    g = _gauge(spark, d)
    return peaks.peak_events(g, ["series"], gap_s=3 * 3600, min_rows=12, distance=6, prominence=20.0).select("t", "v")


def _levels(spark, d):
    return _events(spark, d).select(L.centi(F.col("v")).alias("level"))


def exceedance_counts(spark, d):
    grid = spark.range(281).select((F.col("id") * 200).alias("threshold"))
    return frequency.range_count(_levels(spark, d), grid).select(F.col("threshold").alias("threshold_c"), "n_at_or_above")


def _points(spark, d) -> DataFrame:
    """A scenario for each region: its nations give a rise (hundredths of the level's unit) every few years from 2026 to 2098."""
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("scenario"), (2026 + k * 3).cast("int").alias("year"), (k * k * 13.5 + F.col("n_regionkey") * 100).cast("double").alias("value"))
    return rows.groupBy("scenario", "year").agg(F.max("value").alias("value"))


def _years(spark) -> DataFrame:
    return spark.range(2026, 2101).select(F.col("id").cast("int").alias("year"))


def _curve(spark, d) -> DataFrame:
    return frequency.year_curve(_points(spark, d), _years(spark), ["scenario"])


def year_interp(spark, d):
    return _curve(spark, d).select("scenario", "year", F.rint("value").cast("int").alias("rise_c"))


def rise_from_base(spark, d):
    return frequency.deltas_from(_curve(spark, d), ["scenario"], 2040).select("scenario", "year", F.rint("delta").cast("int").alias("delta_c"))


def exceedance_cube(spark, d):
    curve = _curve(spark, d).select("scenario", "year", F.rint("value").cast("int").alias("delta_c"))
    grid = spark.range(281).select((F.col("id") * 200).cast("int").alias("elev_c"))
    levels = _levels(spark, d)
    total = levels.agg(F.count("level").alias("total"))
    cube = frequency.exceedance_cube(levels, curve.crossJoin(F.broadcast(total)).drop("total"), grid, 1).drop("annual_c").crossJoin(F.broadcast(total))
    cube = cube.withColumn("annual_c", frequency.annual_count(F.col("n_at_or_above"), F.col("total")))
    return cube.groupBy("scenario", "elev_c").agg(F.sum("annual_c").alias("all_years_c"), F.max("annual_c").alias("most_c"))


def crest_ranking(spark, d):
    o = table(spark, d, "orders")
    return frequency.ranked(o, 250000.0, "o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice", L.display_date(F.col("o_orderdate")).alias("display_date"))


def crest_top10(spark, d):
    return crest_ranking(spark, d).limit(10)


def upsert_days(spark, d):
    """Each gauge's days by all events but purchases, replaced where purchases give the day anew."""
    e = _events(spark, d).select("user_id", F.expr("t div 86400").alias("day"), L.centi(F.col("v")).alias("c"), F.col("event_type").eqNullSafe("purchase").alias("anew"))
    days = lambda rows: rows.groupBy("user_id", "day").agg(F.max("c").alias("peak_c"), F.count("*").alias("n"))
    return series.upsert(days(e.where("not anew")), days(e.where("anew")), ["user_id", "day"])


def calibrate_day(spark, d):
    e = _events(spark, d).select("event_id", F.expr("t div 86400").alias("day"), "v")
    return series.calibrate(e, ["day"], "v", 250.0, "stretched").select("event_id", L.centi(F.col("stretched")).alias("level_c"))


def _compact(spark, d):
    q = _quarters(spark, d).withColumns({"day": F.expr("t div 86400"), "pos": F.expr("cast((t % 86400) div 900 as int)")})
    return series.compact(q, ["day"], "pos", "level_c")


def compact_day_array(spark, d):
    joined = F.array_join(F.transform("v", lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")
    return _compact(spark, d).select("day", joined.alias("v"), F.size("v").cast("long").alias("n_slots"), F.size(F.array_compact("v")).cast("long").alias("n_valid"))


def compact_roundtrip(spark, d):
    rows = _compact(spark, d).withColumn("u", F.col("day") * 86400)
    return series.explode_compact(rows, ["day"], "u", 900).select("t", F.col("x").alias("level_c"))


def stage_key(spark, d):
    x = F.col("v") / 20 - 3
    return _events(spark, d).select("event_id", L.stage_key(x).alias("key"), L.clamped(x).alias("clamped"), L.stage_code((F.floor(x * 20) * 5).cast("int")).alias("code"))


def depth_penalty(spark, d):
    stage, ground = F.floor(F.col("v")) / 20, (F.col("event_id") % 50) / 10.0
    depth = L.penalized_depth(stage, ground)
    return _events(spark, d).select("event_id", F.rint(L.vertical_penalty(stage) * 1000).cast("int").alias("penalty_m"), F.rint(depth * 1000).cast("int").alias("depth_m"), L.depth_code(F.rint(depth * 1000), [100, 250, 500, 1000, 1500, 2000, 2500, 3000, 4000, 5000]).alias("code"))


def _grid(spark, d) -> DataFrame:
    rows = raster.from_arrays(table(spark, d, "embeddings").where("embedding is not null"), "vec_id", "embedding")
    return rows.select("y", "x", F.rint(F.col("v").cast("double") * 100).cast("int").alias("elev"))


def packed_lookup(spark, d):
    return _grid(spark, d).select("y", "x", *(c.cast("int").alias(n) for n, c in L.packed(F.col("elev"), F.col("elev") * 4).items()))


def raster_mask_condition(spark, d):
    g = _grid(spark, d)
    mask = F.pmod(F.col("y") + F.col("x"), F.lit(7)) == 0
    return g.select("y", "x", raster.condition(F.col("elev"), mask, 8).alias("elev"), mask.alias("hard"))


def raster_dilate(spark, d):
    return raster.dilate(_grid(spark, d).where("elev >= 30"), 3).select("y", F.col("x").cast("int").alias("x"))


def raster_or_pool(spark, d):
    return raster.or_pool(_grid(spark, d).withColumn("wet", F.col("elev") >= 25), "wet")


def raster_edges(spark, d):
    g = _grid(spark, d).withColumn("zone", F.expr("(y div 10) * 1000 + x div 10"))
    return raster.edges(g, "zone", "elev")


def raster_components(spark, d):
    named = raster.components(_grid(spark, d).where("elev <= -1"))
    sizes = named.groupBy("label").agg(F.count("*").alias("n_cells"), F.min("elev").alias("lowest")).where("n_cells >= 3")
    return sizes.select(F.expr(f"cast(label div {raster.ROW} as bigint)").alias("y"), F.expr(f"cast(label % {raster.ROW} as bigint)").alias("x"), "n_cells", "lowest")


def _connected(spark, d):
    g = _grid(spark, d).withColumn("source", (F.col("x") == 0) & (F.col("elev") <= 0))
    return raster.connection_stage(g, "elev", "source", 25)


def connection_stage(spark, d):
    return _connected(spark, d).select("y", "x", "connection")


def _zoned(spark, d):
    c = _connected(spark, d).where("connection is not null").withColumn("hard", F.col("elev") >= 15)
    return raster.zones(c.withColumn("bin", F.expr("cast((connection + 100) div 20 as int)")), "bin", "hard")


def zone_summary(spark, d):
    s = raster.zone_summary(_zoned(spark, d), "zone_label", "elev", "connection", ["source", "hard"])
    hist = F.array_join(F.transform(F.map_entries("hist"), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    return s.select(F.expr(f"cast(zone_label div {raster.ROW} as bigint)").alias("y"), F.expr(f"cast(zone_label % {raster.ROW} as bigint)").alias("x"), "connection", "cell_count", "source_cells", "hard_cells", hist.alias("hist"))


def stage_wet_cells(spark, d):
    """A cell is wet from the first stage that is above it and at its connection; both counts are ranks among the cells."""
    every = hydraulics.stage_catalogue(spark).withColumn("at", -F.col("stage_c"))
    c = _connected(spark, d).select((F.col("elev") * -10).alias("low"), F.when(F.col("connection").isNotNull(), -F.greatest(F.col("elev") * 10 + 1, F.col("connection") * 10)).alias("wet"))
    c = runtime.save(c.groupBy("low", "wet").count(), "levels")
    low = frequency.range_count(c.select(F.col("low").alias("level"), "count"), every, "level", "at", "n_all", "count")
    both = frequency.range_count(c.select(F.col("wet").alias("level"), "count"), low, "level", "at", "n_wet", "count")
    return both.select("stage_c", "n_wet", (F.col("n_all") - F.col("n_wet")).alias("n_low"))


def _display(spark, d) -> DataFrame:
    """Every second row and column of the connected grid, with the sources pooled to it."""
    c = runtime.save(_connected(spark, d), "connected")
    half = lambda n: F.expr(f"{n} div 2")
    cells = raster.strided(c, 2, 1).select(half("y").alias("y"), half("x").alias("x"), (F.col("elev") * 10).alias("ground_c"), (F.col("connection") * 10).alias("connection_c"))
    pooled = raster.or_pool(c, "source", 2).select(F.col("by").alias("y"), F.col("bx").alias("x"), "source")
    return cells.join(pooled, ["y", "x"])


def render_stages(spark, d):
    """Wet, green and removed cells of the display grid at every stage of the catalogue."""
    return stages.render_counts(_display(spark, d)).select("stage_c", "n_wet", "n_green", "n_removed")


def render_codes(spark, d):
    """Depth and stage codes of the display grid at 1.50 ft, and the smoothed depth in thousandths."""
    cells = runtime.save(_display(spark, d), "display")
    return stages.render_codes(cells, 150, raster.extent(cells)).select("y", "x", "depth_code", "stage_code", F.rint(F.col("depth") * 1000).cast("int").alias("depth_m"))


def _equilibrium(spark, d) -> DataFrame:
    z = _zoned(spark, d)
    hist = z.groupBy(F.col("zone_label").alias("zone_id"), (F.col("elev") + 100).alias("bin")).agg(F.count("*").alias("n"))
    zones = z.groupBy(F.col("zone_label").alias("zone_id")).agg(F.max("connection").alias("connection"))
    e = hydraulics.equilibrium(zones, hist)
    return e.groupBy("stage_c").agg(F.count("*").alias("n_zones"), F.sum("wet_cells").alias("wet_cells"), F.sum("storage_d").alias("storage_d"))


def equilibrium_storage(spark, d):
    e = _equilibrium(spark, d)
    return e.select("stage_c", "n_zones", "wet_cells", (F.col("storage_d") * 10).cast("bigint").alias("storage_c"))


def ring_nearest_valid(spark, d):
    g = _grid(spark, d)
    points = g.select(F.expr("y * 64 + x").alias("pid"), F.col("y").alias("py"), F.col("x").alias("px"))
    return raster.ring_nearest(points, g.where("elev >= 20"), "pid")


def render_source_filter(spark, d):
    g = _grid(spark, d).where("elev <= 2").withColumn("source", F.col("x") < 3)
    return raster.source_connected(g, "source").select("y", "x")


def green_next_to_blue(spark, d):
    g = _grid(spark, d)
    return raster.touching(g.where("elev > 2 and elev <= 6"), g.where("elev <= 2")).select("y", "x")


def smoothed_depth(spark, d):
    g = _grid(spark, d)
    return raster.masked_gaussian(g.where("elev <= 10"), "elev", raster.extent(g)).select("y", "x", F.rint(F.col("smooth") * 100).cast("int").alias("smooth_c"))


def scalar_formats(spark, d):
    o = table(spark, d, "orders")
    hm = F.expr("cast(o_orderkey % 2700 as string)")
    return o.select("o_orderkey", L.normalize_time(hm).alias("time"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), L.first_filled(F.lit(""), F.col("o_orderstatus")).alias("status"))


def tumbling_hours(spark, d):
    return _events(spark, d).groupBy(F.expr("t div 3600").alias("hour")).agg(F.count("*").alias("n"), F.max(L.centi(F.col("v"))).alias("peak_c"))


SQL = oracles.SQL
QUERIES = {name: globals()[name] for name in SQL}
