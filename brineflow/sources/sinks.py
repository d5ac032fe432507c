"""Documents and tables out: JSON documents, CSV and world files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime
from brineflow.operators.series import upsert


def day_document(days: DataFrame, header: dict) -> DataFrame:
    """One JSON document: the header's fields and ``days`` in order; a day is a small record, a document a century of them."""
    fields = [F.lit(v).alias(k) for k, v in header.items()]
    rows = F.array_sort(F.collect_list(F.struct("d", *(c for c in days.columns if c != "d")))).alias("days")
    return days.agg(rows).select(F.to_json(F.struct(*fields, "days")).alias("value"))


def day_documents(days: DataFrame, header: dict, key: str = "series") -> DataFrame:
    """As :func:`day_document`, one document for each ``key``."""
    fields = [F.lit(v).alias(k) for k, v in header.items()]
    rows = F.array_sort(F.collect_list(F.struct("d", *(c for c in days.columns if c not in ("d", key))))).alias("days")
    return days.groupBy(key).agg(rows).select(F.to_json(F.struct(*fields, key, "days")).alias("value"))


def crest_document(crests: DataFrame, header: dict) -> DataFrame:
    """One indented JSON document of the crests, the highest first, dates as text; a table of records is small."""
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("height_ft", *(c for c in crests.columns if c != "height_ft"))))).alias("toptides")
    return crests.agg(ranked).select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in header.items()), "toptides"), {"pretty": "true"}).alias("value"))


def write_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def manifest(files: DataFrame) -> DataFrame:
    """``name, bytes, sha256`` of files (name, content)."""
    return files.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The entries of ``new``, and those of ``old`` that it does not name."""
    return upsert(old, new, ["name"])


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Replace whole rows by key. The merged table is written aside and then takes the old one's place, which is kept until that is done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    now, aside, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.old"))
    fs = now.getFileSystem(conf)
    if not fs.exists(now) and fs.exists(gone):
        fs.rename(gone, now)  # a run that failed between the two renames
    there = fs.exists(now)
    merged = upsert(spark.read.parquet(path), new, keys) if there else new
    merged.write.mode("overwrite").parquet(aside.toString())
    if there:
        fs.delete(gone, True)
        fs.rename(now, gone)
    fs.rename(aside, now)
    fs.delete(gone, True)


def upsert_days(spark: SparkSession, path: str, new: DataFrame, keys: list[str], day: str = "day") -> None:
    """Replace rows by key in a table that is partitioned by ``day``; only the days that ``new`` has are read and written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    merged = new
    if there:
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select(day).distinct()), day, "left_semi")  # one row for each day of a batch
        merged = runtime.save(upsert(old, new, keys), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_zones(zones: DataFrame, path: str) -> None:
    """Zones as CSV, the histogram joined by colons."""
    flat = zones.withColumn("hist_counts", F.array_join(F.transform("hist", lambda x: x.cast("string")), ":")).drop("hist")
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges (zone_a, zone_b, crest10, width_ft) as CSV."""
    edges.select("zone_a", "zone_b", "crest10", "width_ft").write.mode("overwrite").option("header", True).csv(path)


def dense_histogram(hist: F.Column, bins: int = 241) -> F.Column:
    """A map of filled bins as an array of all."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(hist, i.cast("int")), F.lit(0)))


def features(df: DataFrame, geometry: str) -> DataFrame:
    """GeoJSON features, one to a row, with all other columns as properties."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*(c for c in df.columns if c != geometry)).alias("properties"), F.col(geometry).alias("geometry"))).alias("value"))


def world_file(pixel_x: float, pixel_y: float, left: float, top: float, turn_x: float = 0.0, turn_y: float = 0.0) -> str:
    """Six affine lines for the centre of the upper left pixel; ``turn_x`` and ``turn_y`` are the rotation terms."""
    return "".join(f"{v:.12f}\n" for v in (pixel_x, turn_y, turn_x, -pixel_y, left + (pixel_x + turn_x) / 2, top + (turn_y - pixel_y) / 2))


def graph_manifest(cells: DataFrame, zone: str, hard: str, width: int, height: int, transform: tuple[float, ...], stamp: str | None = None) -> DataFrame:
    """One JSON document on a graph of zones: the grid's size and affine transform, the model's constants, and what the cells count.

    ``stamp``: the run's time as the caller gives it, so that a run can be repeated to the byte.
    """
    entries = {
        "schema": F.lit("hydraulic-graph-v4"),
        "width": F.lit(width),
        "height": F.lit(height),
        "cellSizeFt": F.lit(1),
        "sourceStageNavd88Ft": F.lit(C.SOURCE_MAX_D / 10),
        "sourceMinComponentCells": F.lit(C.SOURCE_MIN_CELLS),
        "bulkheadElevationNavd88Ft": F.lit(C.HARD_MIN_D / 10),
        "bulkheadPixelCount": F.count_if(F.col(hard)),
        "modelMaximumNavd88Ft": F.lit(C.MODEL_MAX_D / 10),
        "controlVolumeSizeFt": F.lit(C.TILE),
        "connectionBinFt": F.lit(2.0),
        "zoneCount": F.count_distinct(zone),
        "geotransform": F.array(*(F.lit(float(t)) for t in transform)),
    }
    if stamp is not None:
        entries["generatedUtc"] = F.lit(stamp)
    return cells.agg(*(e.alias(k) for k, e in entries.items())).select(F.to_json(F.struct(*entries)).alias("value"))
