"""Recorded feeds and archives as tables. Schemas are explicit, so absent keys are nulls.

Files that name-by-name fetching would leave behind land in a folder first; the
readers take folders, so Spark splits and prunes them like any other table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow.functions.levels import finite, parsed_level

GAUGE = "value struct<timeSeries:array<struct<values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"
WATER_LEVEL = "data array<struct<t:string,v:string>>, error struct<message:string>"
COMPACT_DAYS = "schema string, days array<struct<d:date,u:bigint,v:array<int>,p:int,c:string,j:string,s:string,x:array<int>>>"
HOURLY_DAYS = "days array<struct<date:string,classification:string,peakNAVD88:double,peakMLLW:double,hours:array<struct<hourIndex:int,timeUtc:string,timeLocal:string,timeEST:string,displayTimeEST:string,navd88StageFt:double,mllwStageFt:double,hydraulicPhase:string>>>>"
CRESTS = "schema string, toptides array<struct<height_ft:double,height_mllw_ft:double,date:string,display_date:string,datum:string,site_no:string,station_name:string,station_short:string,source_area:string,station_priority:int,event_name:string,record_type:string,source_url:string,time_est:string>>"
STATIONS = "issuedUtc string, sourceUrl string, count int, stations array<struct<stationId:string,stationName:string,valueCount:int>>"
FORECASTS = "forecasts map<string,struct<hours:array<struct<mllwStageFt:double,twlMllwFt:double,rawPetssValue:double>>>>"
BOUNDARY = "type string, properties map<string,string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
PROJECTIONS = "SlrProjections array<struct<projectionYear:int,projectionRsl:double,scenario:string>>"
TRENDS = "SeaLvlTrends array<struct<trend:double>>"
ZONES = "zone_id int, connection10 int, cell_count bigint, source_cells bigint, grate_cells bigint, hard_cells bigint, hist_min10 int, hist_counts string"
EDGES = "zone_a int, zone_b int, crest10 int, width_ft bigint"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one to a file; a file that does not parse gives nulls rather than an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def gauge(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`gauge_points`, of the documents under ``path``."""
    return gauge_points(documents(spark, path, GAUGE).withColumn("file", F.input_file_name()))


def gauge_points(docs: DataFrame) -> DataFrame:
    """``t, v, ord``: three nested lists flattened, unparsable stamps and levels out of range dropped."""
    rows = docs.select("file", F.posexplode("value.timeSeries").alias("i", "s"))
    rows = rows.select("file", "i", F.posexplode("s.values").alias("j", "b")).select("file", "i", "j", F.posexplode("b.value").alias("k", "p"))
    t = F.try_to_timestamp(F.regexp_replace("p.dateTime", "Z$", "+00:00"))
    out = rows.select(F.unix_timestamp(t).alias("t"), finite(F.col("p.value").try_cast("double")).alias("v"), F.struct("file", "i", "j", "k").alias("ord"))
    return out.where("t is not null and v is not null")


def water_levels(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`water_level_points`, of the documents under ``path``."""
    return water_level_points(documents(spark, path, WATER_LEVEL))


def water_level_points(docs: DataFrame) -> DataFrame:
    """``t, v``: minute stamps in UTC; a document with an error message and no data gives no rows."""
    rows = docs.select(F.explode("data").alias("p"))
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.expr("try_to_timestamp(p.t, 'yyyy-MM-dd HH:mm')").cast("timestamp_ntz"))
    return rows.select(t.alias("t"), parsed_level(F.col("p.v")).alias("v")).where("t is not null and v is not null")


def tab_records(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records: ``#`` lines are comments, the first line names the columns, the second describes them."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    first = rows.columns[0]
    return rows.where(~F.coalesce(F.col(first).rlike("^[0-9]+[sdn]$"), F.lit(False)))


def forecast_hours(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`forecast_points`, of the documents under ``path``."""
    return forecast_points(documents(spark, path, FORECASTS))


def forecast_points(docs: DataFrame) -> DataFrame:
    """``name, pos, mllw``: the first of the three level fields that is there."""
    rows = docs.select(F.explode("forecasts").alias("name", "f")).select("name", F.posexplode("f.hours").alias("pos", "h"))
    return rows.select("name", "pos", F.coalesce("h.mllwStageFt", "h.twlMllwFt", "h.rawPetssValue").alias("mllw"))


def rings(spark: SparkSession, path: str) -> DataFrame:
    """Outer and inner rings of a boundary document as arrays of (x, y)."""
    rows = documents(spark, path, BOUNDARY).select("properties", F.posexplode("geometry.coordinates").alias("nth", "r"))
    return rows.select("properties", "nth", F.transform("r", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("ring"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ZONES).option("header", True).csv(path)
    return rows.withColumn("hist", F.transform(F.split("hist_counts", ":"), lambda x: x.cast("bigint"))).drop("hist_counts")


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).option("header", True).csv(path).withColumn("crest_ft", F.col("crest10") / 10)


def chunks(first: F.Column, last: F.Column, unit: str, every: int = 1) -> F.Column:
    """Starts of the date ranges that cover first .. last: one request each."""
    start = F.trunc(first, unit) if unit in ("month", "year") else first
    return F.sequence(start, last, F.expr(f"interval {every} {unit}"))


def padded_chunks(spans: DataFrame, first: str, last: str, days: int = 90, pad_s: int = 900) -> DataFrame:
    """The rows of ``spans`` by chunks of ``days`` from ``first`` to ``last`` (dates, both included): ``nth`` and, in epoch seconds, ``from_t`` and ``to_t``, each end widened by ``pad_s``."""
    starts = F.sequence(F.col(first), F.col(last), F.expr(f"interval {days} day"))
    rows = spans.select("*", F.posexplode(starts).alias("nth", "__start"))
    second = lambda d: F.date_diff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    end = F.least(F.date_add("__start", days), F.date_add(last, 1))
    return rows.withColumns({"from_t": second(F.col("__start")) - pad_s, "to_t": second(end) + pad_s}).drop("__start")


def request_url(base: str, **params: F.Column | str) -> F.Column:
    """A request with its parameters encoded; ranges and stations in it are the predicate that the server applies."""
    as_col = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(as_col(v))) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *pairs))


NO_DATA = "No data was found"


def fetched(fetch, url: str, attempts: int, wait) -> str | None:
    """The body, after as many attempts; null where the service says that it has no data for the request."""
    import time

    for k in range(attempts):
        try:
            body = fetch(url)
            return None if NO_DATA in body[:2000] else body
        except OSError as error:
            if NO_DATA in str(error):
                return None
            if k + 1 == attempts:
                raise
            (wait or time.sleep)(min(12, 2**k))
    return None


def landed(spark: SparkSession, requests: DataFrame, fetch, attempts: int = 4, wait=None) -> DataFrame:
    """``url, body``: each request of column ``url`` fetched in its task by ``fetch(url) -> str``, again after a failure; no row where there is no data.

    ``fetch`` is the only part that leaves the cluster; rows keep the input's partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "body": [fetched(fetch, u, attempts, wait) for u in part["url"]]}).dropna()

    return requests.select("url").mapInPandas(run, "url string, body string")


def cached(spark: SparkSession, requests: DataFrame, fetch, folder: str, attempts: int = 4) -> DataFrame:
    """As :func:`landed` for JSON bodies, through files in ``folder`` on any file system: a body that is there and parses is not fetched again, a corrupt one is.

    A run that is cut short goes on where it ended, since each body is a file of its own, written aside and renamed.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import json
        import uuid

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)

        def body_of(url: str) -> str | None:
            path = f"{base}/{hashlib.sha256(url.encode()).hexdigest()}.json"
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_file(path) as f:
                    text = f.read().decode("utf-8", "replace")
                try:
                    json.loads(text)
                    return text
                except ValueError:
                    fs.delete_file(path)
            text = fetched(fetch, url, attempts, None)
            if text is not None:
                aside = f"{path}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(aside) as f:
                    f.write(text.encode())
                fs.move(aside, path)
            return text

        for part in parts:
            yield pd.DataFrame({"url": part["url"], "body": [body_of(u) for u in part["url"]]}).dropna()

    return requests.select("url").mapInPandas(run, "url string, body string")


def paged(spark: SparkSession, requests: DataFrame, fetch, page: int = 1000, attempts: int = 4) -> DataFrame:
    """``url, feature``: the features of each request's pages in their own order, asked for by offset until a page is short.

    ``url`` names the columns and the predicate that the server applies; a request's pages follow each other in one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for part in parts:
            for url in part["url"]:
                offset, held = 0, []
                while True:
                    body = fetched(fetch, f"{url}&resultOffset={offset}&resultRecordCount={page}", attempts, None)
                    found = json.loads(body)["features"] if body else []
                    held += [json.dumps(x) for x in found]
                    offset += len(found)
                    last = len(found) < page
                    # Small pages are handed on together.
                    if last or len(held) >= 2000:
                        yield pd.DataFrame({"url": url, "feature": held}, dtype="object")
                        held = []
                    if last:
                        break

    return requests.select("url").mapInPandas(run, "url string, feature string")


def members_of(files: DataFrame, suffix: str) -> DataFrame:
    """``archive, name, content, sha256``: members of ZIP archives (path, content, sha256) whose names end in ``suffix``, one archive to a row of work."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for part in parts:
            for archive, content, digest in zip(part["path"], part["content"], part["sha256"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)], "sha256": [digest]})

    return files.select("path", "content", "sha256").mapInPandas(run, "archive string, name string, content binary, sha256 string")


def only_member(files: DataFrame, suffix: str) -> DataFrame:
    """As :func:`members_of` for archives that must hold exactly one such member; any other number is an error that names the archive."""
    members = members_of(files, suffix)
    counted = files.select(F.col("path").alias("archive")).join(members.groupBy("archive").count(), "archive", "left")
    checked = counted.select("archive", F.when(F.coalesce("count", F.lit(0)) != 1, F.raise_error(F.concat(F.lit("not exactly one member in "), "archive"))).cast("string").alias("__error"))
    return members.join(checked, "archive").where("__error is null").drop("__error")
