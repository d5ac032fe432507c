"""Operators on irregular level series: ``series``, ``t`` (epoch seconds), ``v``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow import config as C

#: Seconds of a bucket of time: with a row a second at most, the rows that meet in a task.
BUCKET_S = 86_400


def dedupe(df: DataFrame, keys: list[str], order: list[str], value: str = "v") -> DataFrame:
    """The last value of each key by ``order``, which must be total; merged before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def anchors(bounds: DataFrame, step_s: int) -> DataFrame:
    """Every ``step_s`` from ``lo`` up to and without ``hi``, for each series."""
    return bounds.select("series", F.explode(F.sequence("lo", F.col("hi") - step_s, F.lit(step_s))).alias("t"))


def interpolate(samples: DataFrame, at: DataFrame, max_gap_s: int = C.MAX_GAP_S, bucket_s: int = 86_400) -> DataFrame:
    """Linear value at each anchor between the samples around it; null beyond the ends and over long gaps.

    A series is cut in buckets of time, so one long series does not meet in one
    task; each bucket carries in the nearest sample before and after it.
    """
    bucket = F.floor(F.col("t") / bucket_s)
    s = samples.select("series", "t", "v").withColumn("bucket", bucket)
    a = at.select("series", "t").withColumn("bucket", bucket)
    ends = s.groupBy("series", "bucket").agg(F.min(F.struct("t", "v")).alias("lo"), F.max(F.struct("t", "v")).alias("hi"))
    # One row for each series and day with samples or anchors.
    all_ = a.select("series", "bucket").distinct().join(ends, ["series", "bucket"], "left")
    all_ = all_.unionByName(ends.join(a.select("series", "bucket").distinct(), ["series", "bucket"], "left_anti"))
    w = Window.partitionBy("series").orderBy("bucket")
    carry = all_.select(
        "series", "bucket",
        F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    rows = s.select("series", "bucket", "t", F.struct("t", "v").alias("p"), F.lit(0).alias("k"))
    rows = rows.unionByName(a.select("series", "bucket", "t", F.lit(None).cast(rows.schema["p"].dataType).alias("p"), F.lit(1).alias("k")))
    inside = Window.partitionBy("series", "bucket").orderBy("t", "k")
    back = Window.partitionBy("series", "bucket").orderBy(F.desc("t"), "k")
    near = rows.select("series", "bucket", "t", "k", F.last("p", True).over(inside).alias("lo"), F.last("p", True).over(back).alias("hi")).where("k = 1")
    near = near.join(carry, ["series", "bucket"], "left").withColumns({"lo": F.coalesce("lo", "before"), "hi": F.coalesce("hi", "after")})
    t0, v0, t1, v1 = F.col("lo.t"), F.col("lo.v"), F.col("hi.t"), F.col("hi.v")
    line = v0 + (v1 - v0) * ((F.col("t") - t0) / (t1 - t0))
    return near.select("series", "t", F.when(t0 == F.col("t"), v0).when((t1 - t0) <= max_gap_s, line).alias("v"))


def arg_max(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """The row with the largest value of each key, the first by ``ties`` among equals; merged before the shuffle."""
    order = F.struct(F.negative(value).alias("__v"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def nearest_fill(samples: DataFrame, existing: DataFrame, step_s: int = 3600) -> DataFrame:
    """For anchors that ``existing`` lacks, the nearest sample; the first by (t, ord) among equals. Half steps go to the even anchor."""
    anchor = (F.rint(F.col("t") / step_s) * step_s).cast("long")
    near = samples.withColumns({"anchor": anchor, "dist": F.abs(F.col("t") - anchor)})
    rest = [c for c in near.columns if c not in ("series", "anchor")]
    # One row for each anchor is left before the join.
    best = near.groupBy("series", "anchor").agg(F.min_by(F.struct(*rest), F.struct("dist", "t", "ord")).alias("__row")).select("series", "anchor", "__row.*")
    return best.join(existing.select("series", "anchor"), ["series", "anchor"], "left_anti")


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def phase(value: str, partition: list[str], order: list[str], epsilon: float = C.PHASE_EPSILON_FT) -> Column:
    """``filling``, ``draining`` or ``slack`` by the steps before and after; an end has one step."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before, after = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    lo, hi = F.least(before, after), F.greatest(before, after)  # each skips a missing side
    return F.when(lo > epsilon, "filling").when(hi < -epsilon, "draining").otherwise("slack")


def rise_rate(value: str, partition: list[str], order: list[str], per: float = 4.0) -> Column:
    """The step from the row before, by ``per``; for partitions of a bounded number of rows, such as a day's slots."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.coalesce((F.col(value) - F.lag(value).over(w)) / per, F.lit(0.0))


def beside(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column) -> DataFrame:
    """Add ``before`` and ``after``: ``columns`` of the rows next to each in its series, null at its ends.

    ``bucket`` rises with ``order`` and bounds the rows that meet in a task: a series is cut in buckets, and each
    carries in the last row before and the first row after it from a table of one row for each bucket.
    """
    row, at = F.struct(*columns), F.struct(*order)
    rows = df.withColumn("__bucket", bucket).withColumn("__cell", F.struct(*keys, "__bucket"))
    ends = rows.groupBy("__cell").agg(F.min_by(row, at).alias("lo"), F.max_by(row, at).alias("hi"))
    line = Window.partitionBy(*(f"__cell.{k}" for k in keys)).orderBy("__cell.__bucket")
    ends = ends.select("__cell", F.lag("hi").over(line).alias("__left"), F.lead("lo").over(line).alias("__right"))
    inside = Window.partitionBy("__cell").orderBy(*order)
    own = rows.withColumns({"__lag": F.lag(row).over(inside), "__lead": F.lead(row).over(inside)}).join(ends, "__cell")
    return own.withColumns({"before": F.coalesce("__lag", "__left"), "after": F.coalesce("__lead", "__right")}).drop("__cell", "__bucket", "__lag", "__lead", "__left", "__right")


def running(df: DataFrame, keys: list[str], order: list[str], counted: dict[str, Column], bucket: Column) -> DataFrame:
    """Add columns that count, up to each row of its series, the rows for which a condition holds; by buckets as :func:`beside`."""
    rows = df.withColumns({f"__{c}": F.coalesce(x.cast("long"), F.lit(0)) for c, x in counted.items()}).withColumn("__bucket", bucket).withColumn("__cell", F.struct(*keys, "__bucket"))
    sums = rows.groupBy("__cell").agg(*(F.sum(f"__{c}").alias(f"__all_{c}") for c in counted))
    line = Window.partitionBy(*(f"__cell.{k}" for k in keys)).orderBy("__cell.__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__cell", *(F.coalesce(F.sum(f"__all_{c}").over(line), F.lit(0)).alias(f"__first_{c}") for c in counted))
    inside = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"__{c}": F.sum(f"__{c}").over(inside) for c in counted}).join(sums, "__cell")
    return own.withColumns({c: F.col(f"__{c}") + F.col(f"__first_{c}") for c in counted}).drop("__cell", "__bucket", *(f"__{c}" for c in counted), *(f"__first_{c}" for c in counted))


def _time_bucket(bucket_s: int) -> Column:
    return F.floor(F.col("t") / bucket_s)


def rises(df: DataFrame, value: str, keys: list[str], order: list[str], out: str, per: float = 4.0, bucket_s: int = BUCKET_S) -> DataFrame:
    """:func:`rise_rate` as a column of series of any length; ``order`` starts with what ``t`` rises with."""
    rows = beside(df, keys, order, [value], _time_bucket(bucket_s))
    return rows.withColumn(out, F.coalesce((F.col(value) - F.col(f"before.{value}")) / per, F.lit(0.0))).drop("before", "after")


def with_sessions(df: DataFrame, keys: list[str], gap_s: int = C.SESSION_GAP_S, order: tuple[str, ...] = ("t",), bucket_s: int = BUCKET_S) -> DataFrame:
    """Number the runs of rows without a gap longer than ``gap_s``, from 0."""
    rows = beside(df, keys, list(order), ["t"], _time_bucket(bucket_s))
    return running(rows, keys, list(order), {"session": F.col("t") - F.col("before.t") > gap_s}, _time_bucket(bucket_s)).drop("before", "after")


def sessions(df: DataFrame, keys: list[str], gap_s: int = C.SESSION_GAP_S, min_rows: int = C.SESSION_MIN_ROWS, bucket_s: int = BUCKET_S) -> DataFrame:
    """``session``, ``start_t``, ``end_t`` and ``n_rows``: a bucket's rows are merged to a row for each of its sessions, then joined up."""
    rows = with_sessions(df, keys, gap_s, bucket_s=bucket_s)
    return rows.groupBy(*keys, "session").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)


def local_maxima(df: DataFrame, value: str, keys: list[str], order: list[str], bucket_s: int = BUCKET_S) -> DataFrame:
    """Rows above both the row before and the row after."""
    rows = beside(df, keys, order, [value], _time_bucket(bucket_s))
    return rows.where((F.col(value) > F.col(f"before.{value}")) & (F.col(value) > F.col(f"after.{value}"))).drop("before", "after")


def rebase(v: Column, year: Column, trend_ft_per_year: Column | float, to_year: int = 2026) -> Column:
    """A level as it would be with the sea level of ``to_year``."""
    return v + trend_ft_per_year * (F.lit(to_year) - year)


def calibrate(df: DataFrame, keys: list[str], value: str, target: float, out: str) -> DataFrame:
    """Stretch each group from its low so that its peak is ``target``; a flat group stays."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    stretched = lo + (F.col(value) - lo) * (target - lo) / (hi - lo)
    return df.join(bounds, keys).withColumn(out, F.when(hi > lo, stretched).otherwise(F.col(value))).drop("__lo", "__hi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``new`` and what of ``old`` it does not replace."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def compact(df: DataFrame, keys: list[str], position: str, value: str, out: str = "v") -> DataFrame:
    """One row for each key with its values in order of position, nulls kept; a key's positions are bounded (a day's slots)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["x"]).alias(out))


def explode_compact(df: DataFrame, keys: list[str], start: str, step_s: int, array: str = "v") -> DataFrame:
    """The filled slots of compact rows with their times."""
    return df.select(*keys, start, F.posexplode(array).alias("pos", "x")).where("x is not null").select(*keys, (F.col(start) + F.col("pos") * step_s).alias("t"), "x")
