"""Water on a grid at every stage of a catalogue, from one pass over the grid.

A cell is wet from its first stage on, so the wet areas of all stages nest: they
are the parts of one tree that grows by stages. Each tile grows its own part. What
lies inside is counted and done; of what touches the rim, the rim cells, the stages
at which they meet, and the cells and sources that join them by stage go on to the
next level of 8 x 8 tiles, until one is left. No stage is labelled on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import raster

_GROWN = "a bigint, b bigint, s int, n bigint, src boolean, areas bigint, kept bigint, removed bigint"


def first_stage(ground_c: Column, connection_c: Column, step_c: int = C.STAGE_STEP_C) -> Column:
    """The number of the first stage (hundredths, from 0 by ``step_c``) that is above the ground and not below the connection."""
    return F.greatest(F.lit(0), F.floor(ground_c / step_c) + 1, F.ceil(connection_c / step_c)).cast("int")


def grow(a: np.ndarray, b: np.ndarray, at: np.ndarray, node: np.ndarray, joined: np.ndarray, cells: np.ndarray, source: np.ndarray, outward: np.ndarray, least: int) -> tuple[list, list, list]:
    """Grow areas stage by stage: sides (a, b) meet at stage ``at``; ``cells``, some with a ``source``, join ``node`` at stage ``joined``.

    Gives, for the areas that hold ``outward`` nodes, the sides (node, node, stage) and the cells (node, stage, cells, source)
    that tell their further growth; and for all others the change, by stage, of the number of areas, of those with a
    source and at least ``least`` cells, and of the cells in the rest.
    """
    n = len(outward)
    parent, size, sourced = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    name = np.where(outward, np.arange(n), -1)
    by_side, by_cell = np.argsort(at, kind="stable"), np.argsort(joined, kind="stable")
    stages = np.unique(np.concatenate([at, joined]))
    cut_side, cut_cell = np.searchsorted(at[by_side], [stages, stages + 1]), np.searchsorted(joined[by_cell], [stages, stages + 1])
    sides, gains, changes = [], [], []

    def root(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while not np.array_equal(r, parent[r]):
            r = parent[r]
        parent[i] = r
        return r

    def tally(of: np.ndarray) -> np.ndarray:
        closed = of[(name[of] < 0) & (size[of] > 0)]
        good = sourced[closed] & (size[closed] >= least)
        return np.asarray([len(closed), good.sum(), size[closed][~good].sum()], np.int64)

    for k, s in enumerate(stages.tolist()):
        e, m = by_side[cut_side[0, k] : cut_side[1, k]], by_cell[cut_cell[0, k] : cut_cell[1, k]]
        ra, rb, rm = root(a[e]), root(b[e]), root(node[m])
        apart = ra != rb
        old = np.unique(np.concatenate([ra[apart], rb[apart], rm]))
        if not len(old):
            continue
        part = raster._roots(len(old), np.searchsorted(old, ra[apart]), np.searchsorted(old, rb[apart]))
        mine = part[np.searchsorted(old, rm)]
        before = tally(old)
        gained, has = np.zeros(len(old), np.int64), np.zeros(len(old), bool)
        np.add.at(gained, part, size[old])
        np.add.at(gained, mine, cells[m])
        np.logical_or.at(has, part, sourced[old])
        np.logical_or.at(has, mine, source[m])
        named = np.flatnonzero(name[old] >= 0)
        lead = np.full(len(old), -1)
        lead[part[named][::-1]] = name[old[named]][::-1]  # the first of each part
        sides += [(lead[p], o, s) for p, o in zip(part[named].tolist(), name[old[named]].tolist(), strict=True) if lead[p] != o]
        parent[old] = old[part]
        tops = np.unique(part)
        new = old[tops]
        name[new] = lead[tops]
        is_open = lead[tops] >= 0
        size[new], sourced[new] = np.where(is_open, 0, gained[tops]), ~is_open & has[tops]
        gains += [(lead[p], s, gained[p], has[p]) for p in tops[is_open].tolist() if gained[p]]
        change = tally(new) - before
        if change.any():
            changes.append((s, *change.tolist()))
    return sides, gains, changes


def _rows(key: np.ndarray, grown: tuple[list, list, list]) -> pd.DataFrame:
    sides, gains, changes = grown
    parts = [
        pd.DataFrame({"a": [key[i] for i, _, _ in sides], "b": [key[j] for _, j, _ in sides], "s": [s for _, _, s in sides]}),
        pd.DataFrame({"a": [key[i] for i, _, _, _ in gains], "s": [g[1] for g in gains], "n": [g[2] for g in gains], "src": [bool(g[3]) for g in gains]}),
        pd.DataFrame(changes, columns=["s", "areas", "kept", "removed"]),
    ]
    kinds = {"a": "Int64", "b": "Int64", "s": "int32", "n": "Int64", "src": "boolean", "areas": "Int64", "kept": "Int64", "removed": "Int64"}
    return pd.concat([p.reindex(columns=list(kinds)).astype(kinds) for p in parts])


def areas_by_stage(cells: DataFrame, stage: str, source: str, least: int = 2, tile: int = raster.TILE) -> DataFrame:
    """``s`` with the change there of ``areas``, ``kept`` (areas with a source and ``least`` cells) and ``removed`` (cells of the others).

    ``cells``: one row for each cell (y, x) that is ever wet, from its number ``stage`` on.
    """
    own = runtime.save(cells.select("y", "x", F.col(stage).cast("int").alias("s"), F.coalesce(F.col(source), F.lit(False)).alias("src")), "stage-cells")

    def first(g: pd.DataFrame) -> pd.DataFrame:
        y, x, s = g["y"].to_numpy(np.int64), g["x"].to_numpy(np.int64), g["s"].to_numpy(np.int64)
        a, b = raster._pairs_in(y, x)
        rim = (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)
        each = np.arange(len(g))
        return _rows(y * raster.ROW + x, grow(a, b, np.maximum(s[a], s[b]), each, s, np.ones(len(g), np.int64), g["src"].to_numpy(bool), rim, least))

    grown = raster._tiles(own, tile).groupBy("ty", "tx").applyInPandas(first, _GROWN)
    rims = own.where(F.pmod("y", F.lit(tile)).isin(0, tile - 1) | F.pmod("x", F.lit(tile)).isin(0, tile - 1))
    across = raster.neighbour_pairs(rims.select("y", "x", "s"), ["s"]).where(f"floor(y_1 / {tile}) <> floor(y_2 / {tile}) or floor(x_1 / {tile}) <> floor(x_2 / {tile})")
    sides = across.select(raster.cell_id("y_1", "x_1").alias("a"), raster.cell_id("y_2", "x_2").alias("b"), F.greatest("s_1", "s_2").alias("s"))
    graph = runtime.save(grown.unionByName(sides, allowMissingColumns=True), "stage-graph")
    extent = own.agg(*(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    change = ["s", "areas", "kept", "removed"]
    if extent["lo_y"] is None:
        return graph.select(*change)
    if min(extent["lo_y"], extent["lo_x"]) < 0:
        raise ValueError("rows and columns count from zero")
    done, width, top = graph.where("a is null").select(*change), tile, False

    def again(g: pd.DataFrame) -> pd.DataFrame:
        side = g["b"].notna().to_numpy()
        a, b = g.loc[side, "a"].to_numpy(np.int64), g.loc[side, "b"].to_numpy(np.int64)
        node = g.loc[~side, "a"].to_numpy(np.int64)
        key = np.unique(np.concatenate([a, b, node]))
        out = np.concatenate([g.loc[g["out_a"].notna(), "a"], g.loc[g["out_b"].notna(), "b"]]).astype(np.int64)
        place = lambda c: np.searchsorted(key, c)
        stage = g["s"].to_numpy(np.int64)
        grown = grow(place(a), place(b), stage[side], place(node), stage[~side], g.loc[~side, "n"].to_numpy(np.int64), g.loc[~side, "src"].to_numpy(bool), np.isin(key, out), least)
        return _rows(key, grown)

    while not top:
        width *= raster.STEP
        top = all(extent[f"lo_{c}"] // width == extent[f"hi_{c}"] // width for c in ("y", "x"))
        of = {c: raster._of_tile(c, width) for c in ("a", "b")}
        placed = graph.where("a is not null").withColumn("home", F.when(F.col("b").isNull() | (of["a"] == of["b"]), of["a"]))
        passed = placed.where("home is null").drop("home")
        ends = passed.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        marked = placed.where("home is not null")
        for c in ("a", "b"):
            marked = marked.join(ends.select(F.col("cell").alias(c), F.lit(True).alias(f"out_{c}")), c, "left")
        up = marked.select("home", "a", "b", "s", "n", "src", "out_a", "out_b").groupBy("home").applyInPandas(again, _GROWN)
        after = runtime.save(up.unionByName(passed), "stage-graph")
        done, graph = done.unionByName(after.where("a is null").select(*change)), after
    return done.groupBy("s").agg(*(F.sum(c).alias(c) for c in change[1:]))


def render_counts(cells: DataFrame, stages: int = C.STAGES, step_c: int = C.STAGE_STEP_C, tile: int = raster.TILE) -> DataFrame:
    """For each stage ``n_areas`` and ``n_kept`` of the wet areas, ``n_removed`` cells of areas without a source or of one cell, ``n_wet`` and ``n_green`` cells left.

    ``cells``: ``y``, ``x``, ``ground_c``, ``connection_c`` (hundredths; null: never connected) and ``source``. Green are
    the cells at or below the stage that are not wet.
    """
    spark = cells.sparkSession
    cells = cells.where("ground_c is not null").withColumn("s", F.when(F.col("connection_c").isNotNull(), first_stage(F.col("ground_c"), F.col("connection_c"), step_c)))
    cells = runtime.save(cells, "render-cells")
    wet = cells.where(F.col("s") < stages)
    low = cells.groupBy(F.greatest(F.lit(0), F.ceil(F.col("ground_c") / step_c)).cast("int").alias("s")).agg(F.count("*").alias("low"))
    changes = wet.groupBy("s").agg(F.count("*").alias("wet")).join(low, "s", "full").join(areas_by_stage(wet, "s", "source", 2, tile), "s", "full")
    # One row for each stage.
    so_far = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    every = spark.range(stages).select(F.col("id").cast("int").alias("s")).join(changes, "s", "left")
    total = {c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("wet", "low", "areas", "kept", "removed")}
    return every.select((F.col("s") * step_c).alias("stage_c"), *(x.alias(c) for c, x in total.items())).select(
        "stage_c",
        F.col("areas").alias("n_areas"),
        F.col("kept").alias("n_kept"),
        F.col("removed").alias("n_removed"),
        (F.col("wet") - F.col("removed")).alias("n_wet"),
        (F.col("low") - F.col("wet") + F.col("removed")).alias("n_green"),
    )


def render_codes(cells: DataFrame, stage_c: int, grid: tuple[int, int, int, int] | None, tile: int = raster.TILE) -> DataFrame:
    """``y``, ``x``, ``depth_code``, ``stage_code`` and the smoothed ``depth`` (null where green) of the cells drawn at one stage; ``cells`` as in :func:`render_counts`."""
    cells = cells.where("ground_c is not null").select("y", "x", "ground_c", "connection_c", "source")
    wet = cells.where((F.col("ground_c") < stage_c) & (F.col("connection_c") <= stage_c))
    kept = runtime.save(raster.source_connected(wet, "source", 2, tile).select("y", "x", "ground_c", "connection_c"), "render-wet")
    depth = L.penalized_depth(F.lit(stage_c / 100), F.col("ground_c") / 100)
    smooth = raster.masked_gaussian(kept.withColumn("depth", depth), "depth", grid, tile=tile)
    blue = smooth.select(
        "y", "x",
        L.depth_code(F.round("smooth", 9)).alias("depth_code"),
        L.activation_code(F.col("ground_c") / 100, F.col("connection_c") / 100).alias("stage_code"),
        F.col("smooth").alias("depth"),
    )
    green = cells.where(F.col("ground_c") <= stage_c).join(kept, ["y", "x"], "left_anti")
    return blue.unionByName(green.select("y", "x", F.lit(len(L.DEPTH_COLOURS) + 1).alias("depth_code"), F.lit(len(L.STAGE_COLOURS) + 1).alias("stage_code"), F.lit(None).cast("double").alias("depth")))
