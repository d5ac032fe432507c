"""Terrain, hydraulics, parcels and validators over the driver's tables, each with its SQL.

The grid is that of :mod:`brineflow.plans.workloads`; ``customer`` rows are parcels
(squares with holes and second parts), ``part`` rows line segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import frequency, geometry, hydraulics, projection, raster
from brineflow.plans import checks, parcels
from brineflow.plans import workloads as W
from brineflow.plans.oracles import CONN, CURVE, GRID, LEVELS, SIDES, ZONED, _r, _w
from brineflow.runtime import table

ROW = raster.ROW


def _split(label: str = "zone_label"):
    return F.expr(f"cast({label} div {ROW} as bigint)").alias("y"), F.expr(f"cast({label} % {ROW} as bigint)").alias("x")


def _zones(spark, d) -> tuple[DataFrame, DataFrame]:
    """Zones with their connection, and their filled bins."""
    z = runtime.save(W._zoned(spark, d), "zoned")
    hist = z.groupBy(F.col("zone_label").alias("zone_id"), (F.col("elev") + 100).alias("bin")).agg(F.count("*").alias("n"))
    return z.groupBy(F.col("zone_label").alias("zone_id")).agg(F.max("connection").alias("connection"), F.count("*").alias("cells")), hist


def _routed(spark, d) -> DataFrame:
    z = runtime.save(W._zoned(spark, d), "zoned")
    zones = z.groupBy(F.col("zone_label").alias("zone_id")).agg(F.bool_or("source").alias("is_source"), F.lit(0.0).alias("storage"))
    hist = z.groupBy(F.col("zone_label").alias("zone_id"), (F.col("elev") / 10).alias("elev_ft")).agg(F.count("*").alias("n"))
    links = raster.edges(z, "zone_label", "elev").select(F.col("zone_a").alias("a"), F.col("zone_b").alias("b"), (F.col("crest") / 10).alias("crest_ft"), F.col("width").cast("double").alias("width_ft"))
    return hydraulics.routing_step(zones, runtime.save(links, "zone-edges"), 4.0, hist=hist)


def routing_step(spark, d):
    """Fifteen substeps over the zones and edges of the whole grid."""
    return _routed(spark, d).select("zone_id", L.centi(F.col("surface_ft")).alias("surface_c"))


def routing_balance(spark, d):
    """What the edges moved sums to nothing; the storage that is left."""
    r = _routed(spark, d)
    return r.agg(F.count("*").alias("n_zones"), F.count_if(F.col("storage") > 0.01).alias("n_wet"), F.abs(F.rint(F.sum("moved") * 1000)).cast("bigint").alias("residual_m"), F.rint(F.sum("storage")).cast("bigint").alias("held"))


def hypsometric_curves(spark, d):
    _, hist = _zones(spark, d)
    return hydraulics.prefix(hist).select(*_split("zone_id"), "bin", F.col("cum_n").cast("long").alias("cum_n"), F.col("cum_elev").cast("long").alias("cum_elev"))


def surface_from_storage(spark, d):
    """The surface of each zone that holds three tenths over every cell, and of the empty zone."""
    zones, hist = _zones(spark, d)
    asked = zones.select("zone_id", F.explode(F.array(F.lit(0).cast("long"), F.col("cells") * 3)).alias("storage_d"))
    got = hydraulics.surface_from_storage(hist, asked)
    return got.select(*_split("zone_id"), "storage_d", F.rint(F.col("surface_d") * 1000).cast("int").alias("surface_m"))


def _sweep(spark, d) -> DataFrame:
    zones, hist = _zones(spark, d)
    e = hydraulics.equilibrium(zones, hist)
    coded = e.select("stage_c", "zone_id", hydraulics.encoded_surface(F.col("storage_d") / 10, F.col("surface_d") / 10).alias("surface_c"))
    return hydraulics.phases(coded, spark)


def state_sweep(spark, d):
    """All stages and phases: wet zones and their encoded surfaces."""
    return _sweep(spark, d).groupBy("phase", "stage_c").agg(F.count("surface_c").alias("n_wet"), F.count_if(F.col("surface_c").isNull()).alias("n_dry"), F.sum("surface_c").cast("long").alias("sum_c"))


def sweep_metadata(spark, d):
    return hydraulics.sweep_metadata(_sweep(spark, d))


def sweep_phases_equal(spark, d):
    """Stages and zones whose phases differ: none, since the three are one state."""
    return checks.unequal_phases(_sweep(spark, d)).select("stage_c", "zone_id")


def activation_codes(spark, d):
    g = W._connected(spark, d).where("connection is not null")
    code = L.activation_code(F.col("elev") / 5.0, F.col("connection") / 5.0)
    rows = g.select("y", "x", code.alias("code"))
    return rows.select("y", "x", "code", L.colour(F.col("code")).alias("colour"), F.array_join(L.hex_rgb(L.colour(F.col("code"))), ",").alias("rgb"), L.opacity(F.col("code")).alias("alpha"))


def pixel_counts(spark, d):
    """Cells that are set, by blocks of 64 rows, of a mask laid over the elevations."""
    g = W._grid(spark, d)
    mask = g.select("y", "x", (F.pmod(F.col("y") * 3 + F.col("x"), F.lit(5)) < 2).alias("hard"))
    both = raster.aligned(g, mask)
    return both.groupBy(F.expr("cast(y div 64 as int)").alias("block")).agg(F.count_if("hard").alias("n_hard"), F.count_if(F.col("hard") & (F.col("elev") >= 0)).alias("n_high"), F.count("*").alias("n_cells"))


def raster_quantize(spark, d):
    """Tenths of the raw values, with every seventeenth column no number, at every fifth cell."""
    rows = raster.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")
    raw = rows.select("y", "x", F.when(F.col("x") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("v").cast("double") * 200).alias("v"))
    return raster.strided(raw).select("y", "x", raster.quantize(F.col("v")).alias("elev_d"))


def _segments(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k % 50) + 0.25, (k * 7 % 40) + 0.5
    return table(spark, d, "part").select(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") / 4.0 - 5).alias("x1"), (y0 + (k % 11) * 0.75 - 3).alias("y1"))


def rasterized_lines(spark, d):
    return geometry.rasterize_lines(_segments(spark, d))


def _square(x, y, side):
    at = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    return F.array(*(F.struct((x + a * side).cast("double").alias("x"), (y + b * side).cast("double").alias("y")) for a, b in at))


def rasterized_triangles(spark, d):
    k = F.col("n_nationkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a = point(k * 3 + 0.25, k % 5 + 0.3)
    ring = F.array(a, point(k * 3 + 7.6, k % 7 + 2.2), point(k * 3 + 2.1, k % 3 + 9.7), a)
    return geometry.rasterize_fill(table(spark, d, "nation").select("n_nationkey", ring.alias("ring")), "n_nationkey", "ring").select("n_nationkey", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


def _parcels(spark, d) -> DataFrame:
    """Every customer as a polygon in feet: an outer square, a hole in every fourth, a second part in every fifth; every eleventh has none."""
    k = F.col("c_custkey")
    x, y, side = (k * 37 % 640) + 0.5, (k * 91 % 1900) * 1.0, (F.col("c_nationkey") % 3 + 2) * 1.0
    first = F.when(k % 4 == 0, F.array(_square(x, y, side), _square(x + 0.5, y + 0.5, F.lit(1.0)))).otherwise(F.array(_square(x, y, side)))
    parts = F.when(k % 5 == 0, F.array(first, F.array(_square(x + 10, y, F.lit(1.0))))).otherwise(F.array(first))
    return table(spark, d, "customer").select(k.alias("id"), F.when(k % 11 != 0, parts).alias("parts"))


def parcel_centroids(spark, d):
    c = geometry.polygon_centroids(_parcels(spark, d).where("parts is not null"), "id", "parts")
    return c.select("id", F.rint(F.col("cx") * 1000).cast("long").alias("cx_m"), F.rint(F.col("cy") * 1000).cast("long").alias("cy_m"), F.rint(F.col("area") * 1000).cast("long").alias("area_m"))


def projected_points(spark, d):
    """Customers as points along the coast: their place in the plane, in hundredths of a foot, and back in ten-millionths of a degree."""
    k = F.col("c_custkey")
    at = table(spark, d, "customer").select("c_custkey", (k % 1000 / 2500 - 74.9).alias("lon"), (k % 777 / 1000 + 38.8).alias("lat"))
    x, y = projection.STATE_PLANE.forward(F.col("lon"), F.col("lat"))
    back = projection.STATE_PLANE.inverse(F.col("x"), F.col("y"))
    rows = at.select("c_custkey", x.alias("x"), y.alias("y")).select("*", back[0].alias("lon"), back[1].alias("lat"))
    whole = lambda c, by: F.rint(F.col(c) * by).cast("long")
    return rows.select("c_custkey", whole("x", 100).alias("x_c"), whole("y", 100).alias("y_c"), whole("lon", 10**7).alias("lon_e7"), whole("lat", 10**7).alias("lat_e7"))


def _enriched(spark, d) -> DataFrame:
    cells = W._grid(spark, d).where("elev >= 10")
    events = table(spark, d, "events").select((F.col("value") / 40).alias("rebased"))
    return parcels.enriched(_parcels(spark, d), cells, events, 0.0, 1900.0, 10.0)


def parcel_enrichment(spark, d):
    """Ground at each parcel's nearest valid cell, its place on the elevation grid, and the floods expected there."""
    return _enriched(spark, d).select("id", "radius", "elev_d", "model_c", "grid_at", "n_at_or_above", "annual_c")


def parcel_summary(spark, d):
    return parcels.skipped(_parcels(spark, d), _enriched(spark, d))


def flood_record(spark, d):
    """Dear orders as flood events: count, years, span and rate."""
    o = table(spark, d, "orders").where("o_totalprice >= 200000")
    r = parcels.record(o.select(L.epoch_s(F.col("o_orderdate")).alias("t"), F.year("o_orderdate").alias("year")))
    return r.select("n_events", "n_years", F.rint(F.col("span_years") * 1000).cast("int").alias("span_m"), F.rint(F.col("per_year") * 100).cast("int").alias("per_year_c"))


def rise_curves(spark, d):
    """Scenario rises in hundredths of a foot over 2040, from centimetres at the years that ``nation`` gives."""
    return parcels.rise_curves(W._points(spark, d).withColumn("cm", F.col("value") / 10), W._years(spark), 2040)


def low_hard_cells(spark, d):
    g = W._grid(spark, d)
    return checks.low_hard_cells(g.withColumn("hard", F.pmod(F.col("y") + F.col("x"), F.lit(7)) == 0), -8).select("y", "x", "elev")


def _blocks(spark, d) -> DataFrame:
    return W._grid(spark, d).withColumn("zone", F.expr("(y div 10) * 1000 + x div 10"))


def low_hard_edges(spark, d):
    b = _blocks(spark, d)
    zones = b.groupBy(F.col("zone").alias("zone_id")).agg(F.count_if(F.col("zone") % 3 == 0).alias("hard_cells"))
    return checks.low_hard_edges(raster.edges(b, "zone", "elev"), zones, 5)


def mixed_hard_zones(spark, d):
    zones = _blocks(spark, d).groupBy(F.col("zone").alias("zone_id")).agg(F.count("*").alias("cell_count"), F.count_if(F.col("elev") >= 20).alias("hard_cells"))
    return checks.mixed_hard_zones(zones)


def histogram_totals(spark, d):
    """Zones by block whose histogram of whole bins does not sum to their cells: those with a cell beyond it."""
    b = _blocks(spark, d)
    bins = b.where("elev between -25 and 24").groupBy("zone", F.expr("(elev + 25) div 10").alias("bin")).agg(F.count("*").alias("n"))
    hist = bins.groupBy("zone").agg(F.collect_list("n").alias("hist"))
    zones = b.groupBy("zone").agg(F.count("*").alias("cell_count")).join(hist, "zone")
    return checks.histogram_totals(zones).select("zone", "cell_count")


def thin_walls(spark, d):
    g = W._grid(spark, d)
    return checks.thin_walls(g.where("x = 30"), g.where("elev >= -10"))


def mask_mismatch(spark, d):
    g = W._grid(spark, d)
    return checks.mask_mismatch(g.where("elev <= 5"), g.where("elev <= 6 and x % 9 <> 0"))


def unseeded_components(spark, d):
    wet = W._grid(spark, d).where("elev <= -1").withColumn("source", F.col("x") < 3)
    return checks.unseeded(wet, "source").select(*_split("label"), "n", "seeded")


def validator_summary(spark, d):
    """The counts of several validators in one row."""
    return checks.summary(low_hard=low_hard_cells(spark, d), mixed=mixed_hard_zones(spark, d), thin=thin_walls(spark, d), mismatch=mask_mismatch(spark, d), green=W.green_next_to_blue(spark, d))


def exceedance_document(spark, d):
    """The cube as one JSON document for each scenario, written and read again."""
    curve = W._curve(spark, d).select("scenario", "year", F.rint("value").cast("int").alias("delta_c"))
    grid = spark.range(281).select((F.col("id") * 200).cast("int").alias("elev_c"))
    levels = W._levels(spark, d)
    total = levels.agg(F.count("level").alias("total"))
    cube = frequency.exceedance_cube(levels, curve, grid, 1).drop("annual_c").crossJoin(F.broadcast(total))
    cube = cube.withColumn("annual_c", frequency.annual_count(F.col("n_at_or_above"), F.col("total")))
    path = runtime.new_path(spark, "cube")
    parcels.cube_document(cube).write.text(path)
    rows = spark.read.schema("scenario string, elevations array<struct<elev_c:int,counts:array<double>,total:double>>, tidesPerYear int").json(path)
    one = rows.select("scenario", "tidesPerYear", F.explode("elevations").alias("e"))
    return one.select("scenario", F.col("tidesPerYear").alias("tides_per_year"), "e.elev_c", F.size("e.counts").cast("long").alias("n_years"), F.rint(F.get("e.counts", F.lit(9)) * 100).cast("int").alias("tenth_c"), F.rint(F.col("e.total") * 100).cast("long").alias("all_years_c"))


def _blk(extra: str = "") -> str:
    return GRID + ", b AS (SELECT *, (y // 10) * 1000 + x // 10 AS zone FROM g)" + extra


ZC = ZONED + ", hz AS (SELECT label, elev, count(*) AS n FROM w GROUP BY ALL), zc AS (SELECT label, max(connection) AS c, count(*) AS cells FROM w GROUP BY label)"
PRE = ZC + ", cu AS (SELECT label, elev, sum(n) OVER k AS cum_n, sum(n * elev) OVER k AS cum_elev FROM hz WINDOW k AS (PARTITION BY label ORDER BY elev))"
SWEEP = ZC + """, eq AS (SELECT st, zc.label, sum(CASE WHEN elev * 10 <= st THEN n * (st - elev * 10) ELSE 0 END) AS vol FROM zc, (SELECT unnest(range(0, 1405, 5)) AS st) JOIN hz ON hz.label = zc.label WHERE zc.c * 10 <= st GROUP BY ALL),
sw AS (SELECT phase, st, label, CASE WHEN vol / 100.0::DOUBLE > 0.01 THEN st END AS s FROM eq, (VALUES ('filling'), ('slack'), ('draining')) p(phase))"""
MASKS = {
    "low_hard": "SELECT y, x, elev FROM g WHERE (y + x) % 7 = 0 AND elev < -8",
    "mixed": "SELECT zone AS zone_id, count(*) AS cell_count, count(*) FILTER (elev >= 20) AS hard_cells FROM b GROUP BY zone HAVING count(*) FILTER (elev >= 20) > 0 AND count(*) FILTER (elev < 20) > 0",
    "thin": f"SELECT DISTINCT c.y + o.dy * k AS y, c.x + o.dx * k AS x FROM g c, {SIDES}, (VALUES (0), (1), (5), (10)) s(k) WHERE c.x = 30 AND NOT EXISTS (SELECT 1 FROM g m WHERE m.elev >= -10 AND m.y = c.y + o.dy * k AND m.x = c.x + o.dx * k)",
    "mismatch": "SELECT y, x FROM g WHERE (elev <= 5) <> (elev <= 6 AND x % 9 <> 0)",
    "green": f"SELECT DISTINCT a.y, a.x FROM g a, {SIDES} JOIN g b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.elev > 2 AND a.elev <= 6 AND b.elev <= 2",
}
PARCEL = """pc AS (SELECT c_custkey AS id, (c_custkey * 37 % 640) + 0.5::DOUBLE AS x, (c_custkey * 91 % 1900)::DOUBLE AS y, (c_nationkey % 3 + 2)::DOUBLE AS s FROM customer WHERE c_custkey % 11 <> 0),
sq AS (SELECT id, x + s / 2 AS cx, y + s / 2 AS cy, s * s AS a FROM pc UNION ALL SELECT id, x + 1, y + 1, -1 FROM pc WHERE id % 4 = 0 UNION ALL SELECT id, x + 10.5, y + 0.5, 1 FROM pc WHERE id % 5 = 0),
ce AS (SELECT id, sum(cx * a) / sum(a) AS cx, sum(cy * a) / sum(a) AS cy, sum(a) AS area FROM sq GROUP BY id)"""
ENRICH = (
    GRID
    + ", "
    + PARCEL
    + """, gr AS (SELECT id, floor((1900 - cy) / 10)::BIGINT AS py, floor(cx / 10)::BIGINT AS px FROM ce),
nr AS (SELECT id, greatest(abs(y - py), abs(x - px))::INT AS radius, elev FROM gr JOIN g ON y BETWEEN py - 10 AND py + 10 AND x BETWEEN px - 10 AND px + 10 AND elev >= 10
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(abs(y - py), abs(x - px)), (y - py) * (y - py) + (x - px) * (x - px), y, x) = 1),
md AS (SELECT *, least(1400, greatest(0, elev * 10)) AS model_c FROM nr), lv AS (SELECT round_even(value / 40 * 100, 0)::INT AS level FROM events),
ct AS (SELECT model_c, count(level) AS n FROM (SELECT DISTINCT model_c FROM md) LEFT JOIN lv ON level >= model_c GROUP BY model_c)"""
)
TRI = """tr AS (SELECT n_nationkey AS k, n_nationkey * 3 + 0.25::DOUBLE AS ax, n_nationkey % 5 + 0.3::DOUBLE AS ay, n_nationkey * 3 + 7.6::DOUBLE AS bx, n_nationkey % 7 + 2.2::DOUBLE AS by_, n_nationkey * 3 + 2.1::DOUBLE AS cx, n_nationkey % 3 + 9.7::DOUBLE AS cy FROM nation),
sd AS (SELECT k, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM tr UNION ALL SELECT k, bx, by_, cx, cy FROM tr UNION ALL SELECT k, cx, cy, ax, ay FROM tr),
ce AS (SELECT k, y, x FROM tr, (SELECT unnest(range(0, 20)) AS y), (SELECT unnest(range(0, 100)) AS x))"""


def _routing(substeps: int = 15, sea: float = 4.0) -> str:
    """The routing step as a chain of tables, one set for each substep."""
    ctes = [
        ZONED + ", zs AS (SELECT label, bool_or(source) AS src FROM w GROUP BY label), zb AS (SELECT label, elev / 10.0::DOUBLE AS e, count(*)::DOUBLE AS n FROM w GROUP BY label, elev)",
        "zk AS (SELECT label, e, sum(n) OVER k AS cells, sum(n * e) OVER k AS sm FROM zb WINDOW k AS (PARTITION BY label ORDER BY e)), zv AS (SELECT *, cells * e - sm AS held FROM zk), zl AS (SELECT label, min(e) AS e0 FROM zv GROUP BY label)",
        f"zc AS (SELECT zs.label, src, CASE WHEN src THEN coalesce(greatest(0, cells * {sea} - sm), 0) END AS sea_held FROM (SELECT *, {sea}::DOUBLE + 1e-9::DOUBLE AS x FROM zs) zs ASOF LEFT JOIN zv ON zs.label = zv.label AND zs.x >= zv.e)",
        f"zp AS (SELECT a.label AS la, b.label AS lb, greatest(a.elev, b.elev) / 10.0::DOUBLE AS crest FROM w a, (VALUES (0, 1), (1, 0)) o(dy, dx) JOIN w b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> b.label), ze AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, crest, count(*)::DOUBLE AS width FROM zp GROUP BY ALL)",
        f"st0 AS (SELECT label, src, sea_held, coalesce(sea_held, 0) AS storage, CASE WHEN src THEN {sea}::DOUBLE ELSE e0 END AS surface, 0.0::DOUBLE AS moved FROM zc JOIN zl USING (label))",
    ]
    for k in range(substeps):
        ctes += [
            f"lv{k} AS MATERIALIZED (SELECT t.label, t.src, t.storage, t.surface, t.src OR t.storage > 0.01 AS wet, greatest(1, coalesce(cells, 0)) AS area FROM (SELECT *, surface + 1e-9::DOUBLE AS x FROM st{k}) t ASOF LEFT JOIN zv ON t.label = zv.label AND t.x >= zv.e)",
            f"ed{k} AS (SELECT CASE WHEN u.surface >= v.surface THEN a ELSE b END AS f, CASE WHEN u.surface >= v.surface THEN b ELSE a END AS g, greatest(u.surface, v.surface) AS hi, least(u.surface, v.surface) AS lo, 1 / u.area + 1 / v.area AS give, CASE WHEN u.surface >= v.surface THEN u.wet ELSE v.wet END AS wet, crest, width FROM ze JOIN lv{k} u ON u.label = a JOIN lv{k} v ON v.label = b)",
            f"qe{k} AS MATERIALIZED (SELECT f, g, hi, least(CASE WHEN hi > crest THEN 3.1::DOUBLE * width * pow(hi - crest, 1.5::DOUBLE) * sqrt(greatest(0, 1 - pow(least(1, greatest(0, lo - crest) / (hi - crest)), 1.5::DOUBLE))) ELSE 0 END * 60, (hi - lo) / give) AS q FROM ed{k} WHERE wet)",
            f"ou{k} AS (SELECT f AS label, sum(q) AS asked FROM qe{k} WHERE q > 0 GROUP BY f), it{k} AS (SELECT g AS label, sum(q) AS offered, max(hi) AS hi FROM qe{k} WHERE q > 0 GROUP BY g)",
            f"gi{k} AS (SELECT label, CASE WHEN src THEN 1 ELSE least(1, storage / asked) END AS give FROM st{k} JOIN ou{k} USING (label))",
            f"ta{k} AS (SELECT t.label, CASE WHEN src THEN 1 ELSE least(1, greatest(0, coalesce(greatest(0, cells * y - sm), 0) - storage) / offered) END AS take FROM (SELECT st{k}.*, offered, greatest(surface, it{k}.hi) AS y, greatest(surface, it{k}.hi) + 1e-9::DOUBLE AS x FROM st{k} JOIN it{k} USING (label)) t ASOF LEFT JOIN zv ON t.label = zv.label AND t.x >= zv.e)",
            f"mv{k} AS (SELECT f, g, q * least(give, take) AS q FROM qe{k} JOIN gi{k} ON gi{k}.label = f JOIN ta{k} ON ta{k}.label = g WHERE q > 0)",
            f"nt{k} AS (SELECT label, sum(d) AS d FROM (SELECT f AS label, -q AS d FROM mv{k} UNION ALL SELECT g, q FROM mv{k}) GROUP BY label)",
            f"sn{k} AS (SELECT label, src, sea_held, coalesce(sea_held, greatest(0, storage + coalesce(d, 0))) AS storage, moved + coalesce(d, 0) AS moved FROM st{k} LEFT JOIN nt{k} USING (label))",
            f"st{k + 1} AS MATERIALIZED (SELECT t.label, src, sea_held, storage, CASE WHEN src THEN {sea}::DOUBLE WHEN storage <= 1e-7 THEN e0 ELSE least(14.0::DOUBLE, e + (storage - held) / cells) END AS surface, moved FROM sn{k} t JOIN zl ON t.label = zl.label ASOF LEFT JOIN zv ON t.label = zv.label AND t.storage >= zv.held)",
        ]
    return ", ".join(ctes)


SQL = {
    "routing_step": _r(_routing(), "SELECT label AS zone_id, round_even(surface * 100, 0)::INT AS surface_c FROM st15"),
    "routing_balance": _r(_routing(), "SELECT count(*) AS n_zones, count(*) FILTER (storage > 0.01) AS n_wet, abs(round_even(sum(moved) * 1000, 0))::BIGINT AS residual_m, round_even(sum(storage), 0)::BIGINT AS held FROM st15"),
    "hypsometric_curves": _r(PRE, "SELECT label // 4294967296 AS y, label % 4294967296 AS x, elev + 100 AS bin, cum_n::BIGINT AS cum_n, cum_elev::BIGINT AS cum_elev FROM cu"),
    "surface_from_storage": _r(PRE, ", a AS (SELECT label, unnest([0, cells * 3])::BIGINT AS st FROM zc), h AS (SELECT a.label, st, arg_max(elev, elev) AS e, arg_max(cum_n * elev - cum_elev, elev) AS held, arg_max(cum_n, elev) AS n FROM a JOIN cu ON a.label = cu.label AND cum_n * elev - cum_elev <= st GROUP BY ALL) SELECT label // 4294967296 AS y, label % 4294967296 AS x, st AS storage_d, round_even((e + (st - held)::DOUBLE / n::DOUBLE) * 1000, 0)::INT AS surface_m FROM h"),
    "state_sweep": _r(SWEEP, "SELECT phase, st::INT AS stage_c, count(s) AS n_wet, count(*) - count(s) AS n_dry, sum(s)::BIGINT AS sum_c FROM sw GROUP BY ALL"),
    "sweep_metadata": _r(SWEEP, ", ph AS (SELECT phase, st, count(s) AS wet FROM sw GROUP BY ALL) SELECT (SELECT count(DISTINCT st) FROM sw) AS stage_count, (SELECT count(DISTINCT phase) FROM sw) AS phase_count, (SELECT count(DISTINCT label) FROM sw) AS zone_count, (SELECT min(st)::INT FROM sw) AS lowest_c, (SELECT max(st)::INT FROM sw) AS highest_c, (SELECT max(wet) FROM ph) AS most_wet, (SELECT sum(wet)::BIGINT FROM ph) AS all_wet"),
    "sweep_phases_equal": _r(SWEEP, "SELECT st::INT AS stage_c, label AS zone_id FROM sw GROUP BY ALL HAVING count(DISTINCT s) > 1 OR (count(s) > 0 AND count(s) < count(*))"),
    "activation_codes": _r(CONN, ", ac AS (SELECT y, x, greatest(elev / 5.0::DOUBLE, connection / 5.0::DOUBLE) AS hi FROM m WHERE connection IS NOT NULL), cc AS (SELECT y, x, CASE WHEN hi < 3.25 THEN 1 WHEN hi < 4.25 THEN 2 ELSE 3 END AS code FROM ac) SELECT y, x, code, CASE code WHEN 1 THEN '#F4A742' WHEN 2 THEN '#E74C3C' ELSE '#7D3C98' END AS colour, CASE code WHEN 1 THEN '244,167,66' WHEN 2 THEN '231,76,60' ELSE '125,60,152' END AS rgb, 225 AS alpha FROM cc"),
    "pixel_counts": _w(GRID, "SELECT (y // 64)::INT AS block, count(*) FILTER ((y * 3 + x) % 5 < 2) AS n_hard, count(*) FILTER ((y * 3 + x) % 5 < 2 AND elev >= 0) AS n_high, count(*) AS n_cells FROM g GROUP BY 1"),
    "raster_quantize": "WITH g AS (SELECT vec_id AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, unnest(embedding)::DOUBLE * 200 AS v FROM embeddings) SELECT y, x, CASE WHEN x % 17 <> 0 THEN greatest(-300, least(300, (sign(v) * floor(abs(v) * 10 + 0.5::DOUBLE))::INT)) END AS elev_d FROM g WHERE x % 5 = 2 AND y % 5 = 2",
    "rasterized_lines": "WITH s AS (SELECT row_number() OVER () AS k, *, x0 + p_size / 4.0::DOUBLE - 5 AS x1, y0 + (p_partkey % 11) * 0.75::DOUBLE - 3 AS y1 FROM (SELECT p_partkey, p_size, (p_partkey % 50) + 0.25::DOUBLE AS x0, (p_partkey * 7 % 40) + 0.5::DOUBLE AS y0 FROM part)), c AS (SELECT k, 0.0::DOUBLE AS t FROM s UNION SELECT k, 1 FROM s UNION SELECT k, (n - x0) / (x1 - x0) FROM (SELECT *, unnest(generate_series(ceil(least(x0, x1))::BIGINT, floor(greatest(x0, x1))::BIGINT)) AS n FROM s) WHERE x0 <> x1 UNION SELECT k, (n - y0) / (y1 - y0) FROM (SELECT *, unnest(generate_series(ceil(least(y0, y1))::BIGINT, floor(greatest(y0, y1))::BIGINT)) AS n FROM s) WHERE y0 <> y1), m AS (SELECT k, t FROM c WHERE t IN (0, 1) UNION ALL SELECT k, (t + lead(t) OVER (PARTITION BY k ORDER BY t)) / 2 FROM c) SELECT DISTINCT floor(y0 + t * (y1 - y0))::BIGINT AS y, floor(x0 + t * (x1 - x0))::BIGINT AS x FROM m JOIN s USING (k) WHERE t IS NOT NULL",
    "rasterized_triangles": _w(TRI, "SELECT ce.k AS n_nationkey, y, x FROM ce JOIN sd ON ce.k = sd.k AND (y0 > y + 0.5) <> (y1 > y + 0.5) AND x + 0.5 < x0 + (y + 0.5 - y0) / (y1 - y0) * (x1 - x0) GROUP BY ALL HAVING count(*) % 2 = 1"),
    "parcel_centroids": _w(PARCEL, "SELECT id, round_even(cx * 1000, 0)::BIGINT AS cx_m, round_even(cy * 1000, 0)::BIGINT AS cy_m, round_even(area * 1000, 0)::BIGINT AS area_m FROM ce"),
    "parcel_enrichment": _w(ENRICH, "SELECT id, radius, elev AS elev_d, md.model_c, (model_c // 5)::INT AS grid_at, n AS n_at_or_above, least(70500, round_even(n * 70500.0::DOUBLE / (SELECT count(level) FROM lv), 0)::INT) AS annual_c FROM md JOIN ct USING (model_c)"),
    "parcel_summary": _w(ENRICH, "SELECT (SELECT count(*) FROM customer) AS n_all, (SELECT count(*) FROM md) AS n_done, (SELECT count(*) FROM customer) - (SELECT count(*) FROM md) AS n_skipped"),
    "flood_record": "WITH o AS (SELECT epoch(o_orderdate)::BIGINT AS t, year(o_orderdate) AS y FROM orders WHERE o_totalprice >= 200000), r AS (SELECT count(*) AS n, count(DISTINCT y) AS ny, greatest(1.0::DOUBLE, (max(t) - min(t)) / (365.2425::DOUBLE * 86400)) AS s FROM o) SELECT n AS n_events, ny AS n_years, round_even(s * 1000, 0)::INT AS span_m, round_even(n / s * 100, 0)::INT AS per_year_c FROM r",
    "rise_curves": _w(CURVE.replace("max(n_nationkey * n_nationkey * 13.5::DOUBLE + n_regionkey * 100)", "max(n_nationkey * n_nationkey * 13.5::DOUBLE + n_regionkey * 100) / 10 / 30.48::DOUBLE"), "SELECT a.scenario, a.year, round_even((a.v - b.v) * 100, 0)::INT AS delta_c FROM cv a JOIN cv b ON a.scenario = b.scenario AND b.year = 2040"),
    "low_hard_cells": _w(GRID, MASKS["low_hard"]),
    "low_hard_edges": _w(_blk(), ", p AS (SELECT a.zone AS za, b.zone AS zb, greatest(a.elev, b.elev) AS crest FROM b a JOIN b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)) SELECT least(za, zb) AS zone_a, greatest(za, zb) AS zone_b, crest, count(*) AS width FROM p WHERE za <> zb AND crest < 5 AND (za % 3 = 0 OR zb % 3 = 0) GROUP BY ALL"),
    "mixed_hard_zones": _w(_blk(), MASKS["mixed"]),
    "histogram_totals": _w(_blk(), "SELECT zone, count(*) AS cell_count FROM b GROUP BY zone HAVING count(*) FILTER (elev NOT BETWEEN -25 AND 24) > 0 AND count(*) FILTER (elev BETWEEN -25 AND 24) > 0"),
    "thin_walls": _w(GRID, MASKS["thin"]),
    "mask_mismatch": _w(GRID, MASKS["mismatch"]),
    "unseeded_components": _r(GRID, f", k AS (SELECT * FROM g WHERE elev <= -1), nb AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2 FROM k a, {SIDES} JOIN k b ON b.y = a.y + dy AND b.x = a.x + dx), r AS (SELECT y, x, y * 4294967296 + x AS l FROM k UNION SELECT nb.y2, nb.x2, r.l FROM r JOIN nb USING (y, x) WHERE nb.y2 * 4294967296 + nb.x2 > r.l), m AS (SELECT y, x, min(l) AS l FROM r GROUP BY y, x) SELECT l // 4294967296 AS y, l % 4294967296 AS x, count(*) AS n, bool_or(x < 3) AS seeded FROM m GROUP BY l HAVING NOT bool_or(m.x < 3) OR count(*) < 2"),
    "validator_summary": _w(_blk(), "SELECT " + ", ".join(f"(SELECT count(*) FROM ({q})) AS {name}" for name, q in MASKS.items())),
    "projected_points": """
WITH c AS (SELECT 1 / (2 * 298.257222101::DOUBLE - 1) AS n, 3937 / 1200.0::DOUBLE AS ft),
k AS (SELECT n, 2 * sqrt(n) / (1 + n) AS e, 0.9999::DOUBLE * 6378137 * ft / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r,
  n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2,
  61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM c),
p AS (SELECT c_custkey, (c_custkey % 1000) / 2500 - 74.9::DOUBLE AS lon, (c_custkey % 777) / 1000 + 38.8::DOUBLE AS lat FROM customer
  UNION ALL SELECT NULL, -74.5::DOUBLE, 38 + 50 / 60.0::DOUBLE),
q AS (SELECT *, sin(radians(lat)) AS s, radians(lon + 74.5::DOUBLE) AS d FROM p, k),
t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM q),
u AS (SELECT *, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM t),
v AS (SELECT *, r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS x,
  r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS y FROM u)
SELECT c_custkey, round_even((492125 + x) * 100, 0)::BIGINT AS x_c, round_even((y - (SELECT y FROM v WHERE c_custkey IS NULL)) * 100, 0)::BIGINT AS y_c,
  round_even(lon * 10000000, 0)::BIGINT AS lon_e7, round_even(lat * 10000000, 0)::BIGINT AS lat_e7 FROM v WHERE c_custkey IS NOT NULL
""",
    "exceedance_document": _w(CURVE + ", " + LEVELS, ", k AS (SELECT scenario, year, e.elev AS elev_c, e.elev - round_even(v, 0)::INT AS th FROM cv, (SELECT unnest(range(0, 56200, 200))::INT AS elev) e), n AS (SELECT th, count(level) AS n FROM (SELECT DISTINCT th FROM k) LEFT JOIN lv ON level >= th GROUP BY th), a AS (SELECT k.*, least(70500, round_even(n * 70500.0::DOUBLE / (SELECT count(level) FROM lv), 0)::INT) AS annual_c FROM k JOIN n USING (th)) SELECT scenario, 705 AS tides_per_year, elev_c, count(*) AS n_years, max(annual_c) FILTER (year = 2035) AS tenth_c, sum(annual_c)::BIGINT AS all_years_c FROM a GROUP BY ALL"),
}
QUERIES = {name: globals()[name] for name in SQL}
