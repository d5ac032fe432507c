"""Sharding along a Hilbert curve over several metadata dimensions.

Every row gets a cell of a small grid (one axis per metadata column), the cells
are visited in Hilbert order, and the sorted rows are cut into runs. Rows that
are close in all dimensions land in the same files, so the min/max statistics
of the written files prune on any of the dimensions.

The law is ``rows``: row counts of any two shards differ by one at most.

Defined results: a null text counts no bytes and has the checksum of the empty
text; null metadata has the coordinate of the empty string or of zero; a null
``doc_id`` sorts first. Equal rows are neighbours on the curve in any order.
An empty table gives no rows. Extra columns are carried along; the columns this
operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brineflow import runtime

#: Bits of each axis: half octaves of any size that Spark can hold fit.
BITS = 6
ROW_OVERHEAD = 16


def text_coordinate(col: Column, bits: int = BITS) -> Column:
    """Equal strings share a coordinate; a digest spreads the strings over the axis."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int") % (1 << bits)


def size_coordinate(col: Column, bits: int = BITS) -> Column:
    """Half octaves of a size, monotone in it."""
    octave = F.floor(2 * F.log2(F.coalesce(col, F.lit(0)).cast("double") + 1)).cast("int")
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), octave))


def with_hilbert(df: DataFrame, axes: list[str], out: str, bits: int = BITS) -> DataFrame:
    """Add the Hilbert index of the integer columns ``axes`` (each in 0 .. 2**bits - 1).

    One projection per rotation keeps every step inside generated code.
    """
    x = [f"__h{i}" for i in range(len(axes))]
    cur = df.withColumns({h: F.col(a).cast("int") for h, a in zip(x, axes, strict=True)})
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i, h in enumerate(x):
            first, own = F.col(x[0]), F.col(h)
            is_set = own.bitwiseAND(F.lit(q)) != 0
            flip = first.bitwiseXOR(F.lit(low))
            if i == 0:
                cur = cur.withColumn(x[0], F.when(is_set, flip).otherwise(first))
            else:
                swap = first.bitwiseXOR(own).bitwiseAND(F.lit(low))
                cur = cur.withColumns({
                    x[0]: F.when(is_set, flip).otherwise(first.bitwiseXOR(swap)),
                    h: F.when(is_set, own).otherwise(own.bitwiseXOR(swap)),
                })
        q >>= 1
    for a, b in zip(x, x[1:], strict=False):
        cur = cur.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn = F.lit(0)
    for k in range(bits - 1, 0, -1):
        bit = F.col(x[-1]).bitwiseAND(F.lit(1 << k)) != 0
        turn = turn.bitwiseXOR(F.when(bit, F.lit((1 << k) - 1)).otherwise(F.lit(0)))
    cur = cur.withColumn("__turn", turn).withColumns({h: F.col(h).bitwiseXOR(F.col("__turn")) for h in x})
    index = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for h in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(h), k).bitwiseAND(F.lit(1)).cast("long"))
    return cur.withColumn(out, index).drop("__turn", *x)


ADDED = ("size", "text_crc32", "h_lang", "h_source", "h_size", "curve", "curve_row", "shard", "slot", "law", "grown_shard")
KEY = ["curve", "doc_id", "text_crc32"]


def with_curve(docs: DataFrame) -> DataFrame:
    """The rows with ``size``, ``text_crc32``, their coordinates and their ``curve`` index."""
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.drop(*ADDED).withColumns({"size": (F.octet_length(body) + ROW_OVERHEAD).cast("long"), "text_crc32": F.crc32(body.cast("binary"))})
    keyed = keyed.withColumns({"h_lang": text_coordinate(F.col("lang")), "h_source": text_coordinate(F.col("source")), "h_size": size_coordinate(F.col("size"))})
    return with_hilbert(keyed, ["h_lang", "h_source", "h_size"], "curve")


def curve_order(rows: DataFrame) -> DataFrame:
    """Write rows in curve order to the shared folder; ``curve_row`` numbers them within each file run.

    A cell that holds a third of all rows is split by the rest of the sort key,
    since the ranges are cut on the whole key.
    """
    ordered = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("curve_row", F.monotonically_increasing_id())
    path = runtime.new_path(rows.sparkSession, "curve")
    ordered.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(ordered.schema).parquet(path)


def cut(rows: DataFrame, n_shards: int) -> DataFrame:
    """Rows in curve order with ``shard`` and gapless ``slot``; runs of equal length, give or take one."""
    run = F.shiftright(F.col("curve_row"), 33)
    counts = rows.groupBy(run.alias("run")).agg(F.count("*").alias("in_run"))
    # One row for each written run: as many as the shuffle had partitions.
    whole = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("run", (F.sum("in_run").over(whole) - F.col("in_run")).alias("before"), F.sum("in_run").over(Window.partitionBy()).alias("n_rows"))
    ranked = rows.withColumn("run", run).join(F.broadcast(starts), "run").withColumn("rank", F.col("before") + F.col("curve_row").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = ranked.withColumn("shard", F.expr(f"cast(rank * {n_shards} div n_rows as int)"))
    first = F.expr(f"(cast(shard as bigint) * n_rows + {n_shards - 1}) div {n_shards}")
    return placed.withColumns({"slot": F.col("rank") - first, "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).drop("run", "before", "n_rows", "rank")


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All rows, texts and other columns included, with their coordinates, ``shard`` and ``slot``."""
    return cut(curve_order(with_curve(docs)), n_shards)


def write(docs: DataFrame, path: str, n_shards: int = 40, max_rows: int = 100_000) -> None:
    """Write the shards as folders of Parquet files in curve order, so that a filter on language, source or size (``h_lang``, ``h_source``, ``h_size``) skips most files by their statistics.

    Texts are shuffled once, into curve order; the shards are cut from what that leaves, a task for each piece of it.
    """
    ordered = curve_order(with_curve(docs))
    rows = cut(ordered, n_shards).sortWithinPartitions("shard", "slot")
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).partitionBy("shard").parquet(path)
    runtime.drop(ordered)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The shards that :func:`write` left, each row with its ``shard`` and ``slot``; ``schema``: that of the documents."""
    own = [f for f in schema.fields if f.name not in ADDED]
    added = "size bigint, text_crc32 bigint, h_lang int, h_source int, h_size int, curve bigint, slot bigint, law string, grown_shard int, shard int"
    return spark.read.schema(T.StructType([*own, *T.StructType.fromDDL(added).fields])).parquet(path)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    path = runtime.new_path(spark, "shards")
    write(docs, path)
    rows = read(spark, path, docs.schema)
    # The checksum is that of the text as it is read back.
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
