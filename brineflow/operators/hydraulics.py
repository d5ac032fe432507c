"""Storage of zones by level, equilibrium over a stage catalogue, and the routing step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime

#: States (zones times stages) that one task makes.
TASK_STATES = 2_000_000


def stage_catalogue(spark, stages: int = C.STAGES, step_c: int = C.STAGE_STEP_C) -> DataFrame:
    return spark.range(stages).select((F.col("id") * step_c).cast("int").alias("stage_c"))


def prefix(hist: DataFrame) -> DataFrame:
    """Running cells and elevation sums up to each bin of a zone: ``zone_id``, ``bin``, ``n`` with bins in tenths from the lowest."""
    w = Window.partitionBy("zone_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    elev = F.col("bin") + C.HIST_MIN_D
    return hist.select("zone_id", "bin", F.sum("n").over(w).alias("cum_n"), F.sum(F.col("n") * elev).over(w).alias("cum_elev"))


def equilibrium(zones: DataFrame, hist: DataFrame, stages: int = C.STAGES, step_c: int = C.STAGE_STEP_C) -> DataFrame:
    """Each stage (``stage_c``) that a zone's connection reaches, as its surface: ``surface_d``, ``wet_cells`` and ``storage_d`` (tenths of a foot times cells).

    Between two bins of a zone the running sums stand, so each bin gives the stages up to the next one; rows are zones
    times stages, whatever the number of bins (241 at most).
    """
    zones = runtime.save(zones, "zone-connections")
    line = Window.partitionBy("zone_id").orderBy("bin")
    # Before the lowest bin nothing is held.
    below = zones.select("zone_id", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("cum_n"), F.lit(0).cast("long").alias("cum_elev"))
    sums = prefix(hist).select("zone_id", F.col("bin").cast("long").alias("bin"), F.col("cum_n").cast("long").alias("cum_n"), F.col("cum_elev").cast("long").alias("cum_elev")).unionByName(below)
    # A zone's few bins become a row for each stage: dealt by what they become, since merged by their bytes they would meet in few tasks.
    sums = sums.repartition(max(1, -(-zones.count() * stages // TASK_STATES)), "zone_id")
    first = lambda d: F.ceil(10 * d / step_c)  # noqa: E731  of the stages at or above tenths
    spans = sums.withColumns({"lo": F.greatest(F.lit(0), F.coalesce(first(F.col("bin") + C.HIST_MIN_D), F.lit(0))), "next": F.lead("bin").over(line)})
    spans = spans.withColumn("hi", F.least(F.lit(stages), F.coalesce(first(F.col("next") + C.HIST_MIN_D), F.lit(stages))) - 1)
    reached = spans.join(zones.select("zone_id", "connection"), "zone_id").withColumn("lo", F.greatest("lo", first(F.col("connection")))).where("lo <= hi")
    rows = reached.withColumn("stage", F.explode(F.sequence("lo", "hi"))).withColumn("stage_c", (F.col("stage") * step_c).cast("int")).withColumn("surface_d", F.col("stage_c") / 10)
    return rows.select("zone_id", "stage_c", "surface_d", F.col("cum_n").alias("wet_cells"), F.greatest(F.lit(0.0), F.col("cum_n") * F.col("surface_d") - F.col("cum_elev")).alias("storage_d"))


def phases(states: DataFrame, spark) -> DataFrame:
    """The same state for each of the three phases, added last."""
    return states.crossJoin(F.broadcast(spark.createDataFrame([("filling",), ("slack",), ("draining",)], "phase string")))


def encoded_surface(storage: Column, surface_ft: Column) -> Column:
    return F.when(storage > 0.01, F.rint(surface_ft * 100).cast("int"))


def sweep_metadata(states: DataFrame) -> DataFrame:
    """One row on a sweep (phase, stage_c, zone_id, surface_c): its extent, and the most and the sum of wet zones over its stages and phases."""
    each = states.groupBy("phase", "stage_c").agg(F.count("surface_c").alias("wet"))
    extent = states.agg(F.count_distinct("stage_c").alias("stage_count"), F.count_distinct("phase").alias("phase_count"), F.count_distinct("zone_id").alias("zone_count"), F.min("stage_c").alias("lowest_c"), F.max("stage_c").alias("highest_c"))
    return extent.crossJoin(each.agg(F.max("wet").alias("most_wet"), F.sum("wet").alias("all_wet")))


def weir_flow(upper: Column, lower: Column, crest: Column, width: Column) -> Column:
    """Broad-crested weir with submergence; zero below the crest."""
    head, tail = F.greatest(F.lit(0.0), upper - crest), F.greatest(F.lit(0.0), lower - crest)
    drowned = F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(F.least(F.lit(1.0), tail / head), F.lit(1.5))))
    return F.when(head > 0, C.WEIR_COEFFICIENT * width * F.pow(head, F.lit(1.5)) * drowned).otherwise(0.0)


def curves(hist: DataFrame) -> DataFrame:
    """The hypsometric curve of each zone, from ``zone_id``, ``elev_ft``, ``n``: an array of at most 241 bins from the lowest, with running cells, elevation sums and storage."""
    w = Window.partitionBy("zone_id").orderBy("elev_ft").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.where("n > 0").select("zone_id", F.col("elev_ft").cast("double").alias("elev"), F.sum(F.col("n").cast("double")).over(w).alias("cells"), F.sum(F.col("n") * F.col("elev_ft")).over(w).cast("double").alias("sum"))
    bins = F.struct("elev", "cells", "sum", (F.col("cells") * F.col("elev") - F.col("sum")).alias("held"))
    return run.groupBy("zone_id").agg(F.array_sort(F.collect_list(bins)).alias("curve"))


def _last_bin(keep) -> Column:
    return F.try_element_at(F.filter("curve", keep), F.lit(-1))


def _stored(surface: Column) -> Column:
    b = _last_bin(lambda x: x["elev"] <= surface + 1e-9)
    return F.coalesce(F.greatest(F.lit(0.0), b["cells"] * surface - b["sum"]), F.lit(0.0))


def _wetted(surface: Column) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(_last_bin(lambda x: x["elev"] <= surface + 1e-9)["cells"], F.lit(0.0)))


def _level(storage: Column) -> Column:
    """The surface that holds ``storage``: the curve is linear between bins; a dry zone has its lowest bin."""
    b = _last_bin(lambda x: x["held"] <= storage)
    return F.when(storage <= 1e-7, F.col("curve")[0]["elev"]).otherwise(F.least(F.lit(C.HIST_MAX_D / 10), b["elev"] + (storage - b["held"]) / b["cells"]))


def routing_step(zones: DataFrame, edges: DataFrame, source_ft: float, substeps: int = C.SUBSTEPS, dt_s: float = C.SUBSTEP_S, hist: DataFrame | None = None) -> DataFrame:
    """Move water between zones (zone_id, storage, is_source) over edges (a, b, crest_ft, width_ft).

    ``hist`` (zone_id, elev_ft, n) gives each zone's curve; without it a zone is a flat basin of ``area`` and ``floor_ft``.
    All flows of a substep are simultaneous. A donor is a source or holds over 0.01. A flow is limited to what would
    level the pair, a donor's flows to what it holds (sources are exempt), and a receiver's to what lifts it to the
    highest surface that feeds it; the source is then set back to its level. The result adds ``surface_ft`` and
    ``moved`` (net change by edges, over all substeps).

    What does not change, the curves and the edges from either end, is dealt by zone once and kept there (on disk where
    memory is short; both are made again from tables in the shared folder). A substep takes and writes the zones that
    hold water or have done so: the others are as they began. Donors' flows go to their receivers, which limit them,
    then back to the donors, which do so in turn; the sums of both ends are shuffled last.
    """
    shape = curves(zones.select("zone_id", F.col("floor_ft").alias("elev_ft"), F.col("area").alias("n")) if hist is None else hist)
    parts = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sea, one = F.lit(float(source_ft)), F.lit(1.0)
    set_back = lambda s: F.when(F.col("is_source"), _stored(sea)).otherwise(s)
    surface = lambda s: F.when(F.col("is_source"), sea).otherwise(_level(s))
    start = zones.join(shape, "zone_id").withColumn("storage", set_back(F.col("storage").cast("double"))).withColumns({"moved": F.lit(0.0), "surface_ft": surface(F.col("storage"))})
    start = runtime.save(start.withColumn("wetted", _wetted(F.col("surface_ft"))), "routing-start")
    state = ["storage", "moved", "surface_ft", "wetted"]
    basins = start.select("zone_id", "is_source", "curve", *(F.col(c).alias(f"{c}_0") for c in state)).repartition(parts, "zone_id").sortWithinPartitions("zone_id").persist()
    ends = lambda a, b: edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), "crest_ft", "width_ft")
    sides = ends("a", "b").unionByName(ends("b", "a")).repartition(parts, "src").sortWithinPartitions("src").persist()
    before = runtime.save(start.where("is_source or storage <> 0").select("zone_id", "is_source", *state), "routing")
    now = {c: F.coalesce(c, f"{c}_0") for c in state}
    for _ in range(substeps):
        live = before.repartition(parts, "zone_id").sortWithinPartitions("zone_id").persist()
        donors = live.where("is_source or storage > 0.01").select(F.col("zone_id").alias("src"), F.col("is_source").alias("endless"), F.col("storage").alias("held"), F.col("surface_ft").alias("hi"), F.col("wetted").alias("from"))
        over = donors.join(sides, "src").where(F.col("hi") > F.col("crest_ft"))
        e = over.join(basins.withColumnRenamed("zone_id", "dst"), "dst").join(live.select(F.col("zone_id").alias("dst"), *state), "dst", "left").withColumns(now)
        q = F.least(weir_flow(F.col("hi"), F.col("surface_ft"), F.col("crest_ft"), F.col("width_ft")) * dt_s, (F.col("hi") - F.col("surface_ft")) / (1 / F.col("from") + 1 / F.col("wetted")))
        e = e.where(F.col("hi") > F.col("surface_ft")).withColumn("q", q).where("q > 0").withColumn("top", F.struct("hi", _stored(F.col("hi")).alias("full"))).drop("curve")
        to, off = Window.partitionBy("dst"), Window.partitionBy("src")
        room = F.greatest(F.lit(0.0), F.max("top").over(to)["full"] - F.col("storage"))
        e = e.select("src", "dst", "endless", "held", "q", F.when(F.col("is_source"), one).otherwise(F.least(one, room / F.sum("q").over(to))).alias("take"))
        give = F.when(F.col("endless"), one).otherwise(F.least(one, F.col("held") / F.sum("q").over(off)))
        e = e.repartition(parts, "src").select("src", "dst", (F.col("q") * F.least(give, "take")).alias("q"))
        net = e.select(F.explode(F.array(F.struct(F.col("src").alias("zone_id"), (-F.col("q")).alias("d")), F.struct(F.col("dst").alias("zone_id"), F.col("q").alias("d")))).alias("m")).groupBy("m.zone_id").agg(F.sum("m.d").alias("d"))
        change = F.coalesce("d", F.lit(0.0))
        after = live.drop("is_source").join(net, "zone_id", "full").join(basins, "zone_id").withColumns(now)
        after = after.withColumns({"was": F.col("storage"), "moved": F.col("moved") + change, "storage": set_back(F.greatest(F.lit(0.0), F.col("storage") + change))})
        kept = F.col("was") == F.col("storage")
        after = after.withColumn("surface_ft", F.when(kept, F.col("surface_ft")).otherwise(surface(F.col("storage"))))
        after = after.withColumn("wetted", F.when(kept, F.col("wetted")).otherwise(_wetted(F.col("surface_ft"))))
        done, before = before, runtime.save(after.select("zone_id", "is_source", *state), "routing")
        live.unpersist()
        runtime.drop(done)
    basins.unpersist()
    sides.unpersist()
    ended = before.select("zone_id", *(F.col(c).alias(f"{c}_1") for c in state))
    return start.drop("curve").join(ended, "zone_id", "left").withColumns({c: F.coalesce(f"{c}_1", c) for c in state}).drop("wetted", *(f"{c}_1" for c in state))


def surface_from_storage(hist: DataFrame, stored: DataFrame) -> DataFrame:
    """The surface (tenths) at which a zone holds ``storage_d``: storage is linear between the bins of a zone, so it is read off exactly.

    ``stored``: zone_id, storage_d and any other columns; nothing stored gives the lowest occupied bin.
    """
    at = prefix(hist).withColumn("elev", F.col("bin") + C.HIST_MIN_D).withColumn("held", F.col("cum_n") * F.col("elev") - F.col("cum_elev"))
    below = stored.join(at, "zone_id").where(F.col("held") <= F.greatest(F.lit(0), F.col("storage_d")))
    top = below.groupBy(*stored.columns).agg(F.max(F.struct("elev", "held", "cum_n")).alias("m"))
    return top.select(*stored.columns, (F.col("m.elev") + (F.greatest(F.lit(0), F.col("storage_d")) - F.col("m.held")) / F.col("m.cum_n")).alias("surface_d"))
