"""Peaks of level series of any length: no task ever holds a whole series or session.

Rows are numbered across buckets of time; runs of equal levels are one row each,
whatever buckets they cross, and a run above both its neighbours is a candidate,
at its middle. Of candidates nearer than ``distance`` rows the highest stays: blocks
of candidates settle what they can tell alone, and what hangs on the block beside
is asked again with other borders until nothing is open. The lowest level between
a peak and the next higher one on each side comes from a tree of block minima and
maxima, climbed until a block holds something higher and descended to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime
from brineflow.operators import series

#: Entries of a tree node; candidates' block in rows, and the widest that it grows to.
FAN = 256
BLOCK_ROWS, MOST_ROWS = 1 << 16, 1 << 22


def numbered(df: DataFrame, keys: list[str], gap_s: int, bucket_s: int = series.BUCKET_S) -> DataFrame:
    """Levels that are not null, with ``rank`` in the series from 0, ``session`` from 1 and ``run`` of equal levels. ``t`` must be unique in a series."""
    bucket = F.floor(F.col("t") / bucket_s)
    rows = df.select(*keys, "t", "v", F.col("v").cast("float").cast("double").alias("x")).where("x is not null")
    rows = series.beside(rows, keys, ["t"], ["t", "x"], bucket)
    new = F.col("before").isNull() | (F.col("t") - F.col("before.t") > gap_s)
    counted = {"rank": F.lit(True), "session": new, "run": new | (F.col("x") != F.col("before.x"))}
    out = series.running(rows.drop("after"), keys, ["t"], counted, bucket)
    return out.withColumn("rank", F.col("rank") - 1).select(*keys, "t", "v", "x", "rank", "session", "run")


def candidates(rows: DataFrame, keys: list[str], min_rows: int, bucket_runs: int = 4096) -> DataFrame:
    """The middle ``rank`` of each run above both neighbours in its session, and its level ``x``."""
    runs = rows.groupBy(*keys, "run").agg(F.min("session").alias("session"), F.min("x").alias("x"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    runs = series.beside(runs, keys, ["run"], ["session", "x"], F.floor(F.col("run") / bucket_runs))
    top = [(F.col(f"{s}.session") == F.col("session")) & (F.col("x") > F.col(f"{s}.x")) for s in ("before", "after")]
    found = runs.where(top[0] & top[1]).select(*keys, "session", F.expr("(first + last) div 2").alias("rank"), "x")
    long = rows.groupBy(*keys, "session").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select(F.struct(*keys, "session").alias("__s"))
    return found.withColumn("__s", F.struct(*keys, "session")).join(long, "__s").drop("__s")


def decide(rank: np.ndarray, x: np.ndarray, session: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States (0 open, 1 kept, 2 dropped) as far as these candidates, by rising rank, tell: one of ``own`` has all its neighbours here."""
    state = state.copy()
    lo = np.maximum(np.searchsorted(rank, rank - distance + 1), np.searchsorted(session, session))
    hi = np.minimum(np.searchsorted(rank, rank + distance), np.searchsorted(session, session, "right"))
    place = np.empty(len(rank), np.int64)
    order = np.lexsort((rank, x))[::-1]
    place[order] = np.arange(len(rank))
    for i in order.tolist():
        if state[i] == 2:
            continue
        near = slice(lo[i], hi[i])
        if state[i] == 0:
            if not own[i] or (state[near][place[near] < place[i]] != 2).any():
                continue  # a higher neighbour is open, or may stand where this block does not see
            state[i] = 1
        state[near] = np.where(place[near] > place[i], 2, state[near])
    return state


def spaced(found: DataFrame, keys: list[str], distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The highest candidates, later ones among equals, such that none within ``distance`` rows stay together."""
    rows, width, turn = runtime.save(found.withColumn("state", F.lit(0).cast("byte")), "peaks-open"), block_rows, 0
    schema = rows.schema
    while True:
        at = F.col("rank") + (turn % 2) * (width // 2)
        block = lambda c: F.floor(c / width)  # noqa: E731, B023
        dealt = rows.withColumn("block", F.explode(F.array_distinct(F.array(block(at), block(at - distance), block(at + distance)))))
        dealt = dealt.withColumn("own", F.col("block") == block(at))

        def settle(table: pa.Table) -> pa.Table:
            table = table.sort_by("rank")
            own = table.column("own").to_numpy()
            state = decide(*(table.column(c).to_numpy() for c in ("rank", "x", "session", "state")), own, distance)
            table = table.set_column(table.schema.get_field_index("state"), "state", pa.array(state, pa.int8()))
            return table.filter(pa.array(own)).drop_columns(["block", "own"])

        after = runtime.save(dealt.groupBy(*keys, "block").applyInArrow(settle, schema), "peaks-open")
        runtime.drop(rows)
        rows, turn, width = after, turn + 1, min(MOST_ROWS, width * (1 + 3 * (turn % 2)))
        if rows.where("state = 0").isEmpty():
            return rows.where("state = 1").drop("state")


def tree(rows: DataFrame, keys: list[str], fan: int = FAN) -> list[DataFrame]:
    """Levels of nodes ``g`` with the largest (``hi``) and least (``lo``) of each entry below; a wall stands before each session."""
    place = (F.col("rank") + F.col("session")).alias("e")
    walls = rows.groupBy(*keys, "session").agg(F.min("rank").alias("rank")).select(*keys, (place - 1).alias("e"), F.lit(float("inf")).alias("hi"), F.lit(float("inf")).alias("lo"))
    entries = rows.select(*keys, place, F.col("x").alias("hi"), F.col("x").alias("lo")).unionByName(walls)
    levels, last = [], rows.agg(F.max(place)).first()[0] or 0
    while not levels or last > 0:
        # ``fan`` entries in a list at most.
        nodes = entries.groupBy(*keys, F.floor(F.col("e") / fan).alias("g")).agg(F.array_sort(F.collect_list(F.struct("e", "hi", "lo"))).alias("c"))
        levels.append(runtime.save(nodes.select(F.struct(*keys, "g").alias("__node"), F.col("c.hi").alias("hi"), F.col("c.lo").alias("lo")), "peaks-tree"))
        entries = levels[-1].select(*(F.col(f"__node.{k}").alias(k) for k in keys), F.col("__node.g").alias("e"), F.array_max("hi").alias("hi"), F.array_min("lo").alias("lo"))
        last //= fan
    return levels


def _look(nodes: DataFrame, level: DataFrame, keys: list[str], active: Column, node: Column, off: Column) -> DataFrame:
    """Where ``active``: ``idx``, the next entry of ``node`` above x from ``off`` on to the row's side, and ``base`` lowered by what lies between."""
    # Rows that rest keep keys that no node has, so that they do not meet in one task.
    asked = nodes.withColumns({"__node": F.struct(*keys, F.when(active, node).otherwise(-1 - F.col("rank")).alias("g")), "__off": off})
    out = asked.join(level, "__node", "left").withColumn("__off", F.coalesce("__off", F.when(F.col("side") < 0, F.size("hi")).otherwise(-1)))
    left = F.expr("array_max(transform(slice(hi, 1, __off), (h, i) -> if(h > x, i, null)))")
    right = F.expr("array_min(transform(slice(hi, __off + 2, size(hi)), (h, i) -> if(h > x, i + __off + 1, null)))")
    out = out.withColumn("idx", F.when(F.col("hi").isNotNull(), F.when(F.col("side") < 0, left).otherwise(right)))
    left = F.expr("array_min(slice(lo, coalesce(idx, -1) + 2, __off - coalesce(idx, -1) - 1))")
    right = F.expr("array_min(slice(lo, __off + 2, coalesce(idx, size(lo)) - __off - 1))")
    low = F.when(F.col("hi").isNotNull(), F.when(F.col("side") < 0, left).otherwise(right))
    return out.withColumn("base", F.least("base", low)).drop("__node", "__off", "hi", "lo")


def with_prominence(peaks: DataFrame, rows: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """Add ``prominence``: the height over the higher one of the lowest levels towards the next higher level, or the session's end, on each side."""
    levels = tree(rows, keys, fan)
    place = F.col("rank") + F.col("session")
    cur = peaks.withColumns({"side": F.explode(F.array(F.lit(-1), F.lit(1))), "base": F.col("x"), "pos": place, "at": F.lit(None).cast("int"), "up": F.lit(True)})
    for k, level in enumerate(levels):
        cur = _look(cur, level, keys, F.col("up"), F.floor(F.col("pos") / fan), F.pmod("pos", F.lit(fan)).cast("int"))
        found = F.col("up") & F.col("idx").isNotNull()
        node = F.floor(F.col("pos") / fan)
        cur = cur.withColumns({
            "pos": F.when(found, node * fan + F.col("idx")).when(F.col("up"), node).otherwise(F.col("pos")),
            "at": F.when(found, k - 1).otherwise(F.col("at")),
            "up": F.col("up") & ~found,
        }).drop("idx")
    for k in range(len(levels) - 2, -1, -1):
        active = F.col("at") == k
        cur = _look(cur, levels[k], keys, F.coalesce(active, F.lit(False)), F.col("pos"), F.lit(None).cast("int"))
        cur = cur.withColumns({"pos": F.when(active, F.col("pos") * fan + F.col("idx")).otherwise(F.col("pos")), "at": F.when(active, k - 1).otherwise(F.col("at"))}).drop("idx")
    return cur.groupBy(*keys, "session", "rank", "x").agg((F.first("x") - F.max("base")).alias("prominence"))


def peak_events(df: DataFrame, keys: list[str], gap_s: int = C.SESSION_GAP_S, min_rows: int = C.SESSION_MIN_ROWS, distance: int = C.PEAK_DISTANCE, prominence: float = C.PEAK_PROMINENCE_FT, bucket_s: int = series.BUCKET_S, fan: int = FAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``keys``, ``session``, ``t`` and ``v`` of the peaks of each session of ``min_rows`` rows or more; ``t`` is unique in a series, null levels are no rows."""
    rows = runtime.save(numbered(df, keys, gap_s, bucket_s), "peaks-rows")
    kept = spaced(candidates(rows, keys, min_rows), keys, distance, block_rows)
    high = with_prominence(kept, rows, keys, fan).where(F.col("prominence") >= prominence)
    row = F.struct(*keys, "rank").alias("__row")
    return rows.select(row, *keys, "session", "t", "v").join(high.select(row), "__row", "left_semi").drop("__row")
