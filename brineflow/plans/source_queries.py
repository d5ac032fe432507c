"""Sources, sinks and streams over the driver's tables: each writes a table in a feed's or sink's format, reads it back, and has its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.functions import levels as L
from brineflow.operators import hydraulics, series
from brineflow.plans import archive_queries as A
from brineflow.plans import archives
from brineflow.plans import workloads as W
from brineflow.plans.oracles import GRID, ZONED, _r, _w
from brineflow.runtime import table
from brineflow.sources import container, grids, readers, sinks
from brineflow.streaming import gauges


def _written(df: DataFrame, label: str) -> str:
    path = runtime.new_path(df.sparkSession, label)
    df.select("value").write.text(path)
    return path


def gauge_json_scan(spark, d):
    """Events as nested gauge documents, one for each user: levels over 100 and every ninth stamp are not valid and drop out."""
    e = table(spark, d, "events")
    stamp = F.when(F.col("event_id") % 9 == 0, "no stamp").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    point = F.struct(F.format_string("%.2f", F.rint(F.col("value") * 25) / 100).alias("value"), stamp.alias("dateTime"))
    docs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", point.alias("p")))).alias("ps"))
    values = F.array(F.struct(F.transform("ps", lambda x: x["p"]).alias("value")))
    docs = docs.select(F.to_json(F.struct(F.struct(F.array(F.struct(values.alias("values"))).alias("timeSeries")).alias("value"))).alias("value"))
    path = runtime.new_path(spark, "gauge-json")
    docs.repartition(4).write.option("lineSep", "\n").text(path)
    # Line by line here: a document of the service is a file of its own.
    rows = spark.read.schema(readers.GAUGE).json(path)
    return readers.gauge_points(rows.withColumn("file", F.lit(""))).select("t", F.rint(F.col("v") * 100).cast("int").alias("level_c"))


def water_level_scan(spark, d):
    """Six-minute records with empty and impossible levels, and a document that only says that there is no data."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.format_string("%.3f", (F.rint(F.col("value") * 100) - 10000) / 1000))
    docs = e.groupBy("user_id").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t"), level.alias("v"))).alias("data")).select(F.to_json(F.struct("data")).alias("value"))
    none = spark.createDataFrame([('{"error":{"message":"No data was found"}}',)], "value string")
    path = _written(docs.unionByName(none), "levels-json")
    rows = spark.read.schema(readers.WATER_LEVEL).json(path)
    return readers.water_level_points(rows).select("t", F.rint(F.col("v") * 1000).cast("int").alias("level_m"))


def peak_feed_scan(spark, d):
    """Orders as a tab-separated peak feed with comments and a format line."""
    o = A._records(spark, d)
    columns = ["ag_dt", "peak_dt", "ag_gage_ht", "gage_ht", "ag_tm", "peak_tm"]
    lines = o.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in columns)).alias("value"), F.lit(1).alias("nth"))
    head = spark.createDataFrame([("# comment", 0), ("\t".join(columns), 0), ("\t".join(["10d", "10d", "8s", "8s", "6s", "6s"]), 0)], "value string, nth int")
    path = runtime.new_path(spark, "peak-feed")
    head.coalesce(1).unionByName(lines.coalesce(1)).coalesce(1).select("value").write.text(path)  # one feed is one file
    rows = readers.tab_records(spark, path)
    blank = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))
    return archives.crest_rows(blank).select(F.rint(F.col("height_ft") * 100).cast("int").alias("height_c"), "date", "time_est")


def zones_csv_scan(spark, d):
    """Zones by block of the grid, with dense histograms joined by colons, through CSV."""
    b = W._grid(spark, d).withColumn("zone_id", F.expr("cast((y div 25) * 100 + x div 25 as int)"))
    bins = b.groupBy("zone_id", (F.col("elev") + 100).alias("bin")).agg(F.count("*").alias("n"))
    hist = bins.groupBy("zone_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    zones = b.groupBy("zone_id").agg(F.max("elev").cast("int").alias("connection10"), F.count("*").alias("cell_count"), F.count_if(F.col("x") == 0).alias("source_cells"), F.lit(0).cast("long").alias("grate_cells"), F.count_if(F.col("elev") >= 20).alias("hard_cells"))
    path = runtime.new_path(spark, "zones-csv")
    sinks.write_zones(zones.join(hist, "zone_id").withColumns({"hist_min10": F.lit(-100), "hist": sinks.dense_histogram(F.col("h"))}).drop("h"), path)
    z = readers.zones(spark, path)
    total = F.aggregate("hist", F.lit(0).cast("long"), lambda s, x: s + x)
    moment = F.aggregate(F.transform("hist", lambda x, i: x * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return z.select("zone_id", "connection10", "cell_count", "source_cells", "hard_cells", F.size("hist").cast("long").alias("n_bins"), total.alias("total"), moment.alias("moment"))


def edges_csv_scan(spark, d):
    edges = W.raster_edges(spark, d).withColumnsRenamed({"crest": "crest10", "width": "width_ft"})
    path = runtime.new_path(spark, "edges-csv")
    sinks.write_edges(edges, path)
    return readers.edges(spark, path).select("zone_a", "zone_b", "crest10", "width_ft", F.rint(F.col("crest_ft") * 10).cast("int").alias("again10"))


def state_container_scan(spark, d):
    """Surfaces of all zones by stage and phase through the packed container; zones are numbered in scan order."""
    z = runtime.save(W._zoned(spark, d), "zoned")
    every = z.groupBy("zone_label").agg(F.max("connection").alias("connection"))
    ids = runtime.save(W.raster.numbered(z), "zone-ids")
    n_zones = ids.count()
    # Dealt by the states that a zone becomes, neighbours together: their slots lie side by side.
    zones = every.join(ids, "zone_label").repartitionByRange(max(1, -(-n_zones * 281 // hydraulics.TASK_STATES)), "zone_id")
    states = zones.join(F.broadcast(hydraulics.stage_catalogue(spark)), F.col("connection") * 10 <= F.col("stage_c"))
    surfaces = hydraulics.phases(states.select((F.col("stage_c") / 5).cast("int").alias("stage"), F.col("zone_id").cast("int").alias("zone_id"), F.col("stage_c").alias("surface_c")), spark)
    path = runtime.new_path(spark, "states")
    container.write(surfaces, path, 281, n_zones, {"unit": "ft"})
    return container.read(spark, path).groupBy("phase", "stage").agg(F.count("*").alias("n_wet"), F.sum("zone_id").cast("long").alias("sum_zone"), F.sum("surface_c").cast("long").alias("sum_c"))


def raw_grid_scan(spark, d):
    """The grid through raw files of blocks of rows, written and read by tasks."""
    g = W._grid(spark, d)
    path = runtime.new_path(spark, "raw-grid")
    size = g.agg(F.max("y") + 1, F.max("x") + 1).first()
    grids.write(g.select("y", "x", F.col("elev").alias("v")), path, size[1], size[0], "int16", block_rows=64)
    return grids.read(spark, path).select("y", "x", F.col("v").alias("elev"))


def graph_manifest(spark, d):
    """The manifest of the graph of zones, written as a document and read back."""
    z = runtime.save(W._zoned(spark, d), "zoned")
    size = z.agg(F.max("y") + 1, F.max("x") + 1).first()
    doc = sinks.graph_manifest(z, "zone_label", "hard", size[1], size[0], (100.0, 1.0, 0.0, 200.0, 0.0, -1.0), "2024-01-01T00:00:00Z")
    path = runtime.new_path(spark, "manifest")
    sinks.write_document(doc, path)
    entries = "width bigint, height bigint, zoneCount bigint, bulkheadPixelCount bigint, sourceStageNavd88Ft double, modelMaximumNavd88Ft double, geotransform array<double>, generatedUtc string"
    return spark.read.schema(entries).json(path).select(
        "width",
        "height",
        F.col("zoneCount").alias("n_zones"),
        F.col("bulkheadPixelCount").alias("n_hard"),
        F.col("sourceStageNavd88Ft").alias("source_ft"),
        F.col("modelMaximumNavd88Ft").alias("model_max_ft"),
        F.array_join(F.transform("geotransform", lambda x: x.cast("int").cast("string")), ",").alias("transform"),
        F.col("generatedUtc").alias("stamp"),
    )


def forecast_scan(spark, d):
    """Forecast hours by user, where the level is in the first, second or third field."""
    e = table(spark, d, "events")
    k, v = F.col("event_id") % 3, F.round(F.col("value") / 25, 3)
    hour = F.struct(F.when(k == 0, v).alias("mllwStageFt"), F.when(k <= 1, v + 1).alias("twlMllwFt"), (v + 2).alias("rawPetssValue"))
    one = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", hour.alias("h")))), lambda x: x["h"]).alias("hours"))
    docs = one.select(F.to_json(F.struct(F.create_map(F.concat(F.lit("u"), "user_id"), F.struct("hours")).alias("forecasts"))).alias("value"))
    path = _written(docs, "forecast-json")
    rows = readers.forecast_points(spark.read.schema(readers.FORECASTS).json(path))
    return rows.select("name", F.col("pos").cast("long").alias("pos"), F.rint(F.col("mllw") * 1000).cast("int").alias("mllw_m"))


def projection_scan(spark, d):
    """Scenario projections and a trend as documents, read with their schemas."""
    points = W._points(spark, d)
    docs = points.groupBy().agg(F.collect_list(F.struct(F.col("year").alias("projectionYear"), F.col("value").alias("projectionRsl"), "scenario")).alias("SlrProjections")).select(F.to_json(F.struct("SlrProjections")).alias("value"))
    rows = spark.read.schema(readers.PROJECTIONS).json(_written(docs, "projections")).select(F.explode("SlrProjections").alias("p")).select("p.*")
    trend = table(spark, d, "region").groupBy().agg(F.avg("r_regionkey").alias("t")).select(F.to_json(F.struct(F.array(F.struct(F.col("t").alias("trend"))).alias("SeaLvlTrends"))).alias("value"))
    t = spark.read.schema(readers.TRENDS).json(_written(trend, "trend")).select(F.explode("SeaLvlTrends").alias("s")).select(L.inches_per_decade_to_ft_per_year(F.col("s.trend")).alias("ft_year"))
    rise = series.rebase(F.col("projectionRsl"), F.col("projectionYear"), F.col("ft_year"))
    return rows.crossJoin(F.broadcast(t)).select("scenario", F.col("projectionYear").alias("year"), F.rint(rise * 1000).cast("long").alias("rebased_m"))


def zip_member_scan(spark, d):
    """Suppliers as text files in ZIP archives, one for each nation; members are chosen by their ending."""

    def zipped(parts):
        import io
        import zipfile

        for part in parts:
            out = []
            for names, bodies in zip(part["names"], part["bodies"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for name, body in zip(names, bodies, strict=True):
                        z.writestr(name, body)
                        z.writestr(name + ".idx", b"no")
                out.append(buffer.getvalue())
            yield part[["path"]].assign(content=out)

    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".txt"))).alias("names"), F.collect_list("s_name").alias("bodies"))
    files = s.select(F.concat(F.lit("n"), F.col("s_nationkey"), F.lit(".zip")).alias("path"), "names", "bodies").mapInPandas(zipped, "path string, content binary")
    got = readers.members_of(runtime.save(files, "zips").withColumn("sha256", F.sha2("content", 256)), ".txt")
    return got.select("archive", "name", F.col("content").cast("string").alias("body"), F.sha2("content", 256).alias("member_sha256"))


def feature_sink(spark, d):
    """Customers as point features, one JSON object a row, read back."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.struct(F.lit("Point").alias("type"), F.array((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_nationkey") * 3).cast("double")).alias("coordinates")).alias("geometry"))
    path = _written(sinks.features(c, "geometry"), "features")
    rows = spark.read.schema("type string, properties struct<c_custkey:bigint,c_mktsegment:string>, geometry struct<type:string,coordinates:array<double>>").json(path)
    return rows.select("type", "properties.*", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


def compact_document_sink(spark, d):
    """Civil days as one document for each gauge, read with the archive's schema."""
    days = A._days(spark, d).select("series", "d", "u", "v", "p", "c")
    path = _written(sinks.day_documents(days, {"schema": "compact-days"}), "days-json")
    rows = spark.read.schema("series string, " + readers.COMPACT_DAYS).json(path)
    return rows.select("series", "schema", F.explode("days").alias("x")).select("series", "schema", F.col("x.d").alias("d"), F.col("x.u").alias("u"), F.col("x.p").alias("p"), F.col("x.c").alias("c"), A._joined("x.v").alias("v"))


def crest_document_sink(spark, d):
    """The dearest orders as a crest document, read back in its order."""
    crests = archives.crest_rows(A._records(spark, d), 7.5).select("height_ft", F.col("date").cast("string").alias("date"), "display_date", "time_est")
    path = runtime.new_path(spark, "crests")
    sinks.write_document(sinks.crest_document(crests, {"schema": "crests"}), path)
    rows = readers.documents(spark, path, readers.CRESTS).select("schema", F.posexplode("toptides").alias("nth", "r"))
    return rows.select((F.col("nth") + 1).cast("long").alias("rank"), F.rint(F.col("r.height_ft") * 100).cast("int").alias("height_c"))


def upserted_day_table(spark, d):
    """Two loads into a table that is partitioned by day: the second replaces its gauges' days and leaves the others."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), L.centi(F.col("value")).alias("c"), F.col("event_type").eqNullSafe("purchase").alias("anew"))
    days = e.groupBy("anew", "user_id", "day").agg(F.max("c").alias("peak_c"), F.count("*").alias("n"))
    path = runtime.new_path(spark, "day-table")
    columns = ["user_id", "peak_c", "n", "day"]
    sinks.upsert_days(spark, path, days.where("not anew").select(*columns), ["user_id", "day"])
    sinks.upsert_days(spark, path, days.where("anew").select(*columns), ["user_id", "day"])
    return spark.read.parquet(path).select("user_id", F.col("day").cast("date").alias("day"), "peak_c", "n")


def asset_manifest(spark, d):
    """Pages as assets: sizes and digests, where a second run's assets (even ids, shorter by a byte) take the first's place."""
    p = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    first = sinks.manifest(p.select(F.concat(F.lit("p"), "page_id").alias("name"), F.col("html").cast("binary").alias("content")))
    second = sinks.manifest(p.where("page_id % 2 = 0").select(F.concat(F.lit("p"), "page_id").alias("name"), F.concat(F.lit("v2 "), "html").cast("binary").alias("content")))
    return sinks.merge_manifest(first, second)


def manifest_totals(spark, d):
    return asset_manifest(spark, d).agg(F.count("*").alias("n_assets"), F.sum("bytes").cast("long").alias("n_bytes"))


def _pages_of(path: str):
    """A feature service over rows that lie in their order in a folder for each predicate: a page is read from the row groups that its offsets are in."""
    index, read = {}, {}

    def groups_of(fs, folder: str) -> tuple[list[tuple[str, int]], list[int]]:
        """Row groups of a folder, in order, and the rows before each, from the files' footers."""
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        places, before = [], [0]
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            for name in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")):
                meta = pq.read_metadata(name, filesystem=fs)
                for k in range(meta.num_row_groups):
                    places.append((name, k))
                    before.append(before[-1] + meta.row_group(k).num_rows)
        return places, before

    def fetch(url: str) -> str:
        from bisect import bisect_right
        from urllib.parse import parse_qs, urlsplit

        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        lo, n, columns = int(q["resultOffset"]), int(q["resultRecordCount"]), q["outFields"].split(",")
        fs, base = pafs.FileSystem.from_uri(path)
        folder = f"{base}/{q['where']}"
        if folder not in index:
            index.clear()
            index[folder] = groups_of(fs, folder)
        places, before = index[folder]
        rows, at = [], lo
        while at < min(lo + n, before[-1]):
            k = bisect_right(before, at) - 1
            # Pages follow each other, so the row group that was read last is mostly asked again.
            if (places[k], q["outFields"]) not in read:
                read.clear()
                with fs.open_input_file(places[k][0]) as f:
                    read[places[k], q["outFields"]] = pq.ParquetFile(f).read_row_group(places[k][1], columns=columns)
            rows += read[places[k], q["outFields"]].slice(at - before[k], lo + n - at).to_pylist()
            at = lo + len(rows)
        return json.dumps({"features": [{"attributes": r} for r in rows]})

    return fetch


def _service(customers: DataFrame, path: str) -> None:
    """Rows for :func:`_pages_of`: by nation, in files and small row groups that follow each other by key."""
    dealt = customers.repartitionByRange("c_nationkey", "c_custkey").sortWithinPartitions("c_nationkey", "c_custkey")
    dealt.write.partitionBy("c_nationkey").option("parquet.block.size", 1 << 18).parquet(path)


def paged_feature_scan(spark, d):
    """Customers through a paginated service, a request for each nation, 25 features a page; requests are asked side by side."""
    path = runtime.new_path(spark, "service")
    _service(table(spark, d, "customer"), path)
    nations = table(spark, d, "nation")
    asked = nations.repartition(max(1, nations.count())).select(readers.request_url("https://feature.test/query", where=F.concat(F.lit("c_nationkey="), "n_nationkey"), outFields="c_custkey,c_mktsegment", orderByFields="c_custkey").alias("url"))
    rows = readers.paged(spark, asked, _pages_of(path), 25)
    got = rows.select(F.from_json("feature", "attributes struct<c_custkey:bigint,c_mktsegment:string>").alias("f")).select("f.attributes.*")
    return got.select("c_custkey", "c_mktsegment")


def cached_scan(spark, d):
    """Each region fetched into a cache, then read from it: the second reader has no service to ask."""
    names = table(spark, d, "region").select(F.concat(F.lit("https://feed.test/"), "r_regionkey").alias("url"), "r_name")
    folder = runtime.new_path(spark, "cache")
    asked = names.select("url")

    def fetch(url: str) -> str:
        return json.dumps({"key": int(url.rsplit("/", 1)[1]), "body": "x" * len(url)})

    def gone(url: str) -> str:
        raise OSError("not there any more")

    readers.cached(spark, asked, fetch, folder).count()
    rows = readers.cached(spark, asked, gone, folder, 1)
    return rows.select(F.from_json("body", "key int, body string").alias("b")).select("b.key", F.length("b.body").cast("long").alias("n"))


def _events_as_stream(spark, d) -> DataFrame:
    """A stream takes folders: the table's own, or the one that its single file lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    one_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return reader.option("pathGlobFilter", "events.parquet").parquet(d) if one_file else reader.parquet(f"{d}/events.parquet")


def _stream(spark, d) -> DataFrame:
    e = _events_as_stream(spark, d)
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), L.centi(F.col("value")).alias("v"), "user_id")


def _run(spark, d, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stream's whole input through the keyed sink, partitioned by the day of the last key, and the table that it leaves."""
    path = runtime.new_path(spark, "stream")
    rows = rows.withColumn("day", F.col(keys[-1]).cast("date"))
    query = gauges.replace_partitions(rows, path, keys, runtime.new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def stream_hourly_peaks(spark, d):
    got = _run(spark, d, gauges.hourly_peaks(_stream(spark, d)), ["series", "hour"])
    return got.select("series", F.unix_timestamp("hour").alias("hour"), "peak", "n")


def stream_quarter_peaks(spark, d):
    got = _run(spark, d, gauges.quarter_peaks(_stream(spark, d)), ["series", "quarter"])
    return got.select("series", F.unix_timestamp("quarter").alias("quarter"), "peak", "n")


def stream_with_states(spark, d):
    """Forecast rows as they come, each with the state made before for its stage."""
    states = hydraulics.stage_catalogue(spark, 100, 500).select(F.col("stage_c").alias("stage"), (F.col("stage_c") * 2).alias("state"))
    rows = gauges.with_states(_stream(spark, d).withColumn("stage", F.expr("cast(v div 500 * 500 as int)")), states).select("series", "stage", "state", "v", F.unix_micros("ts").alias("at"), "user_id")
    path = runtime.new_path(spark, "stream")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", runtime.new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).groupBy("series", "stage").agg(F.max("state").alias("state"), F.count("*").alias("n"), F.sum("v").cast("long").alias("sum_c"))


def stream_day_table(spark, d):
    """Days of each user replaced by key, in a table partitioned by day."""
    e = _events_as_stream(spark, d)
    days = e.select("user_id", F.col("ts").cast("date").alias("day"), L.centi(F.col("value")).alias("c")).groupBy("user_id", "day").agg(F.max("c").alias("peak_c"), F.count("*").alias("n")).select("user_id", "peak_c", "n", "day")
    path = runtime.new_path(spark, "stream")
    gauges.replace_partitions(days, path, ["user_id", "day"], runtime.new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("user_id", F.col("day").cast("date").alias("day"), "peak_c", "n")


TS = "ev AS (SELECT event_type AS series, floor(epoch(ts))::BIGINT AS t, round_even(value * 100, 0)::INT AS v FROM events)"
SQL = {
    "gauge_json_scan": "SELECT floor(epoch(ts))::BIGINT AS t, round_even(value * 25, 0)::INT AS level_c FROM events WHERE event_id % 9 <> 0 AND round_even(value * 25, 0) < 10000",
    "water_level_scan": "SELECT floor(epoch(ts))::BIGINT // 60 * 60 AS t, round_even(value * 100, 0)::INT - 10000 AS level_m FROM events WHERE event_id % 7 <> 0 AND round_even(value * 100, 0) - 10000 BETWEEN -30000 AND 30000",
    "peak_feed_scan": f"WITH {A.REC} SELECT round_even(height_ft * 100, 0)::INT AS height_c, date, CASE WHEN regexp_full_match(four, '([01][0-9]|2[0-3])[0-5][0-9]') THEN four[1:2] || ':' || four[3:4] END AS time_est FROM f",
    "zones_csv_scan": _w("g AS (SELECT vec_id AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, round_even(unnest(embedding)::DOUBLE * 100, 0)::INT AS elev FROM embeddings)", "SELECT ((y // 25) * 100 + x // 25)::INT AS zone_id, max(elev)::INT AS connection10, count(*) AS cell_count, count(*) FILTER (x = 0) AS source_cells, count(*) FILTER (elev >= 20) AS hard_cells, 241 AS n_bins, count(*) FILTER (elev BETWEEN -100 AND 140) AS total, (sum(elev + 100) FILTER (elev BETWEEN -100 AND 140))::BIGINT AS moment FROM g GROUP BY 1"),
    "edges_csv_scan": f"SELECT zone_a::INT AS zone_a, zone_b::INT AS zone_b, crest AS crest10, width AS width_ft, crest AS again10 FROM ({W.SQL['raster_edges']})",
    "state_container_scan": _r(ZONED, ", zc AS (SELECT label, max(connection) AS c, min((y // 25) * 1000000 + x // 25) AS tile FROM w GROUP BY label), zi AS (SELECT *, row_number() OVER (ORDER BY tile, label) - 1 AS zone_id FROM zc) SELECT phase, (st // 5)::INT AS stage, count(*) AS n_wet, sum(zone_id)::BIGINT AS sum_zone, sum(st)::BIGINT AS sum_c FROM zi JOIN (SELECT unnest(range(0, 1405, 5)) AS st) ON c * 10 <= st, (VALUES ('filling'), ('slack'), ('draining')) p(phase) GROUP BY ALL"),
    "raw_grid_scan": _w(GRID, "SELECT y, x, elev FROM g"),
    "graph_manifest": _r(
        ZONED,
        """SELECT max(x) + 1 AS width, max(y) + 1 AS height, count(DISTINCT label) AS n_zones, count(*) FILTER (hard) AS n_hard,
1.0::DOUBLE AS source_ft, 14.0::DOUBLE AS model_max_ft, '100,1,0,200,0,-1' AS transform, '2024-01-01T00:00:00Z' AS stamp FROM w""",
    ),
    "forecast_scan": "SELECT 'u' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, round_even((round(value / 25, 3) + event_id % 3) * 1000, 0)::INT AS mllw_m FROM events",
    "projection_scan": "WITH p AS (SELECT 'r' || n_regionkey AS scenario, (2026 + n_nationkey * 3)::INT AS year, max(n_nationkey * n_nationkey * 13.5::DOUBLE + n_regionkey * 100) AS v FROM nation GROUP BY ALL), t AS (SELECT avg(r_regionkey) / 12 / 10 AS f FROM region) SELECT scenario, year, round_even((v + f * (2026 - year)) * 1000, 0)::BIGINT AS rebased_m FROM p, t",
    "zip_member_scan": "SELECT 'n' || s_nationkey || '.zip' AS archive, 's' || s_suppkey || '.txt' AS name, s_name AS body, sha256(s_name) AS member_sha256 FROM supplier",
    "feature_sink": "SELECT 'Feature' AS type, c_custkey, c_mktsegment, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_nationkey * 3)::DOUBLE AS lat FROM customer",
    "compact_document_sink": f"WITH {A.DAYS} SELECT series, 'compact-days' AS schema, d, u, p, c, v FROM dy",
    "crest_document_sink": f"WITH {A.REC} SELECT row_number() OVER (ORDER BY height_ft DESC) AS rank, round_even(height_ft * 100, 0)::INT AS height_c FROM f WHERE height_ft >= 7.5",
    "upserted_day_table": "WITH d AS (SELECT user_id, ts::DATE AS day, round_even(value * 100, 0)::INT AS c, event_type IS NOT DISTINCT FROM 'purchase' AS anew FROM events), o AS (SELECT user_id, day, max(c) AS peak_c, count(*) AS n FROM d WHERE NOT anew GROUP BY ALL), w AS (SELECT user_id, day, max(c) AS peak_c, count(*) AS n FROM d WHERE anew GROUP BY ALL) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = o.user_id AND w.day = o.day) UNION ALL SELECT * FROM w",
    "asset_manifest": "SELECT 'p' || page_id AS name, strlen(CASE WHEN page_id % 2 = 0 THEN 'v2 ' ELSE '' END || coalesce(html, ''))::BIGINT AS bytes, sha256(CASE WHEN page_id % 2 = 0 THEN 'v2 ' ELSE '' END || coalesce(html, '')) AS sha256 FROM pages",
    "manifest_totals": "SELECT count(*) AS n_assets, sum(strlen(coalesce(html, '')) + CASE WHEN page_id % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS n_bytes FROM pages",
    "paged_feature_scan": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)",
    "cached_scan": "SELECT r_regionkey::INT AS key, length('https://feed.test/' || r_regionkey) AS n FROM region",
    "stream_hourly_peaks": _w(TS, "SELECT series, t // 3600 * 3600 AS hour, max(v) AS peak, count(*) AS n FROM ev GROUP BY ALL"),
    "stream_quarter_peaks": _w(TS, "SELECT series, t // 900 * 900 AS quarter, max(v) AS peak, count(*) AS n FROM ev GROUP BY ALL"),
    "stream_with_states": _w(TS, "SELECT series, (v // 500 * 500)::INT AS stage, CASE WHEN v // 500 * 500 < 50000 THEN (v // 500 * 1000)::INT END AS state, count(*) AS n, sum(v)::BIGINT AS sum_c FROM ev GROUP BY ALL"),
    "stream_day_table": "SELECT user_id, ts::DATE AS day, max(round_even(value * 100, 0)::INT) AS peak_c, count(*) AS n FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
