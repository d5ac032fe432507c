"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: its weight as a line through knots over the
training time 0 .. 1. The area below it, against that of the others, is the
source's part of the budget; a source that would be read more than
``MOST_PASSES`` times stops there and the others share what is left by weight.
The part of the area up to a moment is the part of its words that a source has
given by then, so a document's place among its source's words, put into the
inverse of that curve, is its position in the training. The mix is sorted by
position.

The documents of a source come in the order of a digest of id and text. The
place of a document is the words of all digest ranges before its own (counted
first, without the texts) and those before it in its range. Time is cut in
slices of about equal demand; texts are shuffled once, to the slices that their
range reaches into, and each slice keeps the documents whose own positions it has.

Defined results: a null text has no words and is never taken; null sources are
one source, after all others; a source without words has the target 0; a
document at which a source's target ends is taken up to it, to the nearest
word; rows that repeat id and text stand side by side, each once in a pass; a
null id is an id; an empty table gives no rows. Other columns are carried along
and the columns added replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow import runtime

WORD = r"[^\x20\x09-\x0D]+"
#: Of all words, and of a source's own.
BUDGET_PERCENT, MOST_PASSES = 150, 2
#: Weights of the sources in turn, as knots (time, weight): heavy ones fall, light ones rise; their areas are 5, 2 and 1.
CURRICULUM = [[(0.0, 7.0), (1.0, 3.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)]]
#: Rows of a digest range, about, and ranges of all sources together at most, beside one for each source.
RANGE_ROWS, MOST_RANGES = 16, 500_000
#: Rows of a table that is broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 600_000
#: Pieces of time in which demand is taken as even, and bytes of a slice.
GRID, SLICE_BYTES = 256, 256 << 20
ADDED = ("size", "source_size", "target", "taken", "pass", "words", "position", "slice")


def areas(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """For each piece of a schedule: its start, the weight there, its slope, and the area before it; last, the whole area as a piece of no length."""
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (t1 - t0) * (w0 + w1) / 2
    return [*out, (knots[-1][0], knots[-1][1], 0.0, area)]


def curriculum(schedules: list[list[tuple[float, float]]]) -> Column:
    """The pieces of each schedule, as an array of arrays."""
    piece = lambda p: F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("t", "w", "slope", "area"), p, strict=True)))
    return F.array(*(F.array(*map(piece, areas(s))) for s in schedules))


def given(pieces: Column, time: Column) -> Column:
    """The part (0 .. 1) of its area that a schedule has given by a time."""
    at = F.element_at(F.filter(pieces, lambda x: x["t"] <= time), -1)
    tau = time - at["t"]
    return (at["area"] + tau * (at["w"] + at["slope"] * tau / 2)) / F.element_at(pieces, -1)["area"]


def position(pieces: Column, part: Column) -> Column:
    """The time at which a schedule has given ``part`` (0 .. 1) of its area: the inverse of :func:`given`."""
    y = part * F.element_at(pieces, -1)["area"]
    at = F.element_at(F.filter(pieces, lambda x: x["area"] <= y), -1)
    rest = y - at["area"]
    root = at["w"] + F.sqrt(F.greatest(F.lit(0.0), at["w"] * at["w"] + 2 * at["slope"] * rest))
    return at["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / root)


def source_key() -> Column:
    """Sources as strings of which none is null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def digest() -> Column:
    """The order of a source's documents."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def high_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def n_words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def targets(narrow: DataFrame, schedules: list[list[tuple[float, float]]] = CURRICULUM, percent: int = BUDGET_PERCENT, most_passes: int = MOST_PASSES) -> DataFrame:
    """A row for each source: ``key``, ``n_rows``, ``n_bytes``, ``source_size``, ``pieces``, ``target`` and ``goal``, the target in whole words.

    With the sources by rising cap for their weight, the first k stop at their caps and the rest share what these leave;
    k is the least for which the next one's share is within its cap.
    """
    rows = narrow.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.sum("size").alias("source_size"))
    # From here on, one row for each source.
    turn = F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1
    rows = rows.withColumn("turn", turn).withColumn("pieces", F.get(curriculum(schedules), F.col("turn") % len(schedules)))
    rows = rows.withColumns({"weight": F.element_at("pieces", -1)["area"], "cap": most_passes * F.col("source_size")}).withColumn("ratio", F.col("cap") / F.col("weight"))
    line = Window.orderBy("ratio", "turn")
    capped = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(Window.partitionBy()) * (percent / 100) - capped
    rows = rows.withColumn("level", left / F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf")))))
    return rows.withColumn("goal", F.round("target").cast("long")).select("key", "n_rows", "n_bytes", "source_size", "pieces", "target", "goal")


def digest_ranges(narrow: DataFrame, sources: DataFrame, rows_each: int) -> DataFrame:
    """``key``, ``range``, the words ``before`` it in its source and those ``within``."""
    cut = narrow.join(sources.select("key", _n_ranges(rows_each).alias("n_ranges")), "key")
    sums = cut.groupBy("key", _range_of(F.col("high")).alias("range")).agg(F.sum("size").alias("within"))
    running = F.sum("within").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sums.withColumn("before", running - F.col("within"))


def _n_ranges(rows_each: int) -> Column:
    return F.ceil(F.col("n_rows") / rows_each).cast("long")


def _range_of(high: Column) -> Column:
    return F.shiftright(high * F.col("n_ranges"), 32)


def demand_curve(sources: DataFrame) -> list[float]:
    """The part of all targets that is given by each of GRID + 1 even times."""
    times = sources.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    sums = times.groupBy("k").agg(F.sum(F.col("target") * given(F.col("pieces"), F.col("k") / GRID)).alias("words"))
    got = {r["k"]: r["words"] for r in sums.collect()}
    whole = got.get(GRID, 0.0)
    return [got[k] / whole if whole else k / GRID for k in range(GRID + 1)]


def _slice_of(time: Column, curve: list[float], n_slices: int) -> Column:
    at = F.least(F.floor(time * GRID).cast("int"), F.lit(GRID - 1))
    known = F.array(*map(F.lit, curve))
    part = F.get(known, at) + (F.get(known, at + 1) - F.get(known, at)) * (time * GRID - at)
    return F.greatest(F.lit(0), F.least(F.floor(part * n_slices).cast("int"), F.lit(n_slices - 1)))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a saved table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def mix(docs: DataFrame, schedules: list[list[tuple[float, float]]] = CURRICULUM, percent: int = BUDGET_PERCENT, most_passes: int = MOST_PASSES, rows_each: int = RANGE_ROWS) -> DataFrame:
    """The mix: a row each time a document is taken, with ``pass``, ``words`` taken and ``position``, sorted by it from file to file.

    Each document has its row of pass 0, even one that is not taken: that has no words, no position and no text. All
    rows tell the document's ``size`` and the words ``taken`` in all passes, and its source's ``source_size`` and ``target``.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    wide = docs.withColumns({"size": n_words(), "__key": source_key(), "__digest": digest()})
    narrow = runtime.save(wide.select(F.col("__key").alias("key"), high_bits(F.col("__digest")).alias("high"), "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "mix-sizes")
    sources = runtime.save(targets(narrow, schedules, percent, most_passes), "mix-sources")
    whole = sources.agg(F.sum("n_rows").alias("n"), F.sum("n_bytes").alias("bytes")).first()
    rows_each = max(rows_each, -(-(whole["n"] or 0) // MOST_RANGES))
    ranges = runtime.save(digest_ranges(narrow, sources, rows_each), "mix-ranges")
    n_slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (whole["bytes"] or 0) * percent // 100 // SLICE_BYTES)
    curve = demand_curve(sources)
    known = sources.select(F.col("key").alias("__key"), _n_ranges(rows_each).alias("n_ranges"), "source_size", "target", F.col("goal").alias("__goal"), F.col("pieces").alias("__pieces"))
    rows = wide.join(_small(known), "__key").withColumn("__range", _range_of(high_bits(F.col("__digest")))).drop("n_ranges")
    rows = rows.join(_small(ranges.select(F.col("key").alias("__key"), F.col("range").alias("__range"), F.col("before").alias("__before"), F.col("within").alias("__within"))), ["__key", "__range"])
    goal, size = F.col("__goal"), F.col("source_size")
    time = lambda words: position(F.col("__pieces"), F.least(F.lit(1.0), words / F.col("target")))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
    first = F.col("pass") * size + F.col("__before")
    rows = rows.withColumn("__read", first < goal).where((F.col("pass") == 0) | F.col("__read"))
    other = F.pmod(F.col("__range"), F.lit(n_slices)).cast("int")
    rows = rows.withColumns({
        "__from": F.when(F.col("__read"), _slice_of(time(first), curve, n_slices)).otherwise(other),
        "__to": F.when(F.col("__read"), _slice_of(time(first + F.col("__within")), curve, n_slices)).otherwise(other),
        "text": F.when(F.col("__read"), F.col("text")),
    })
    rows = rows.withColumn("slice", F.explode(F.sequence("__from", "__to"))).repartition(n_slices, "slice")
    same = Window.partitionBy("slice", "pass", "__key", "__range").orderBy("__digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__place", F.col("__before") + F.sum("size").over(same) - F.col("size"))
    part = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), goal - p * size - F.col("__place")))
    rows = rows.withColumns({"words": part(F.col("pass")), "taken": sum((part(F.lit(p)) for p in range(1, most_passes)), part(F.lit(0)))})
    rows = rows.withColumn("position", F.when(F.col("words") > 0, time(F.col("pass") * size + F.col("__place"))))
    own = F.when(F.col("words") > 0, F.greatest("__from", F.least("__to", _slice_of(F.col("position"), curve, n_slices)))).otherwise(F.col("__from"))
    rows = rows.where((F.col("slice") == own) & ((F.col("pass") == 0) | (F.col("words") > 0))).withColumn("text", F.when(F.col("words") > 0, F.col("text")))
    path = runtime.new_path(spark, "mix")
    rows = rows.select(*docs.columns, *ADDED).sortWithinPartitions("slice", "position")
    rows.write.option("compression", "zstd").parquet(path)
    for done in (narrow, ranges):
        runtime.drop(done)
    return spark.read.schema(rows.schema).parquet(path)


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    return mix(docs).where("pass = 0").select("doc_id", "size", "source_size", "target", "taken")
