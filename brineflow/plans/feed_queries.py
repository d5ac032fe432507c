"""The gauge feed as a source and as a stream, over bodies that events are recorded in, and levels at anchors from a stream; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import series
from brineflow.plans import workloads as W
from brineflow.plans.oracles import E, _w
from brineflow.sources import feeds
from brineflow.streaming import gauges, interpolation


def _samples(spark, d) -> DataFrame:
    """Every event as a sample of the station that its type names."""
    e = W._events(spark, d).where("event_type is not null")
    return e.select(F.col("event_type").alias("station"), F.expr("cast(date_add(date'1970-01-01', cast(t div 86400 as int)) as date)").alias("day"), "t", "ts", "event_id", (F.rint(F.col("v") * 25) / 100).alias("v"))


def _recorded(samples: DataFrame, base: str) -> None:
    """Bodies as the service sends them: one for each station and day, its samples in order of time."""
    point = F.struct(F.format_string("%.2f", "v").alias("value"), L.utc_stamp(F.col("t")).alias("dateTime"))
    days = samples.groupBy("station", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", point.alias("p")))).alias("ps"))
    values = F.array(F.struct(F.transform("ps", lambda x: x["p"]).alias("value")))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(values.alias("values"))).alias("timeSeries")).alias("value")))
    rows = days.select("station", "day", body.alias("value")).repartition("station", "day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station", "day").text(base)


def _span(samples: DataFrame) -> dict:
    """Stations (kinds of events, few) and days of the whole table, as the feed's options."""
    found = samples.agg(F.min("day"), F.max("day"), F.collect_set("station")).first()
    return {"start": str(found[0]), "end": str(found[1]), "stations": ",".join(sorted(found[2]))}


def feed_source_scan(spark, d):
    s = _samples(spark, d)
    base = runtime.new_path(spark, "feed")
    _recorded(s, base)
    rows = feeds.feed(spark, base=base, chunk_days=7, **_span(s))
    return rows.select("station", "day", "t", F.rint(F.col("v") * 100).cast("int").alias("level_c"))


def feed_stream_archive(spark, d):
    """The feed archived in two runs: a quarter of the last three days' samples of the first run come late, after it, and are in the archive all the same."""
    s = runtime.save(_samples(spark, d), "samples")
    base, path, checkpoint = (runtime.new_path(spark, n) for n in ("feed", "archive", "archive-checkpoint"))
    span = _span(s)
    half = s.select(F.date_add(F.min("day"), 14).alias("half")).first()[0]
    until = F.lit(half)
    late = (F.col("day") > F.date_sub(until, 3)) & (F.col("event_id") % 4 == 0)
    _recorded(s.where((F.col("day") <= until) & ~late), base)
    for last in (str(half), span["end"]):
        stream = feeds.feed_stream(spark, base=base, chunk_days=7, stations=span["stations"], start=span["start"], end=last)
        gauges.archive_days(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
        _recorded(s.where(F.col("day") > F.date_sub(until, 3)), base)
    rows = spark.read.schema("station string, t bigint, v double, day date").parquet(path)
    return rows.select("station", "day", "t", F.rint(F.col("v") * 100).cast("int").alias("level_c"))


def stream_anchor_levels(spark, d):
    """Quarter-hour levels of each kind's gauge from its samples as they come; a last sample ten days on moves the watermark past all others."""
    e = W._events(spark, d).where("event_type is not null").withColumn("series", F.col("event_type"))
    g = series.dedupe(e, ["series", "t"], ["ts", "event_id"])
    ends = g.groupBy("series").agg((F.max("t") + 864_000).alias("t"), F.lit(0.0).alias("v"))
    folder = runtime.new_path(spark, "samples")
    columns = ("series", F.timestamp_seconds("t").alias("ts"), "v")
    # Dealt by a digest, so that what a batch reads is in no order of time; the ends come in a later batch.
    g.select(*columns).repartition(F.xxhash64("t")).write.parquet(f"{folder}/a")
    ends.select(*columns).write.parquet(f"{folder}/b")
    path, store, checkpoint = runtime.new_path(spark, "anchors"), "spark.sql.streaming.stateStore.providerClass", runtime.new_path(spark, "anchors-checkpoint")
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("a", "[ab]"):
            stream = spark.readStream.schema("series string, ts timestamp, v double").parquet(f"{folder}/{part}")
            rows = interpolation.anchors(stream)
            rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema("series string, t bigint, v double").parquet(path).select("series", "t", L.centi(F.col("v")).alias("level_c"))


_FEED = _w(
    E.replace("value AS v", "event_type, round_even(value * 25, 0)::INT AS level_c"),
    """SELECT event_type AS station, (DATE '1970-01-01' + (t // 86400)::INT)::DATE AS day, t, arg_max(level_c, (ts, event_id)) FILTER (level_c < 10000) AS level_c
FROM e WHERE event_type IS NOT NULL GROUP BY ALL HAVING bool_or(level_c < 10000)""",
)
SQL = {
    "feed_source_scan": _FEED,
    "feed_stream_archive": _FEED,
    "stream_anchor_levels": _w(
        E.replace("value AS v", "event_type AS series, value AS v"),
        """, g AS (SELECT series, t, arg_max(v, (ts, event_id)) AS v FROM e WHERE series IS NOT NULL GROUP BY ALL),
s AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM g WINDOW w AS (PARTITION BY series ORDER BY t)),
b AS (SELECT series, t0, v0, t, v, unnest(generate_series((t0 // 900 + 1) * 900, t, 900)) AS a FROM s WHERE t - t0 <= 43200
  UNION ALL SELECT series, t0, v0, t, v, t FROM s WHERE t % 900 = 0 AND (t0 IS NULL OR t - t0 > 43200))
SELECT series, a AS t, round_even((CASE WHEN a = t THEN v ELSE v0 + (v - v0) * ((a - t0) / (t - t0)) END) * 100, 0)::INT AS level_c FROM b""",
    ),
}
QUERIES = {"feed_source_scan": feed_source_scan, "feed_stream_archive": feed_stream_archive, "stream_anchor_levels": stream_anchor_levels}
