"""Web archives: records written by Spark's text sink, read back by boundary-chain verification.

A record is a header block, a blank line, the payload and the separator that
the sink puts after every row. Payloads that occur before, by digest, are
written as revisits of the record with the smallest page id.

Reading splits the files at every occurrence of the magic line, wherever it
stands. Each piece that starts like a record is a candidate with a successor:
its offset plus its header and declared length. Pointer jumping from the start
of each file keeps the candidates that are reached, so that magic lines inside
payloads are not taken for records; payloads that were cut at such lines are
put together again.

Defined results: a null page counts as an empty payload; a null page id is
written as an empty one and read as null; payloads under ``MIN_REVISIT`` bytes
are never revisits; rows that repeat the smallest page id of a payload are all
responses; an empty table writes an empty archive; of a file whose chain breaks the
records before the break are read, and :func:`broken_files` names it. Columns other than the page
id, URL and html are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow import runtime

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
#: Records of one file at most: bounds what one task sorts and jumps over.
FILE_RECORDS = 20_000
#: Repeated payloads up to this many are broadcast (some 50 bytes each), more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
DATE = "1970-01-01T00:00:00Z"


def _escaped(col: Column) -> Column:
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        col = F.replace(col, F.lit(char), F.lit(code))
    return col


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """Digest and smallest page id of the payloads that occur more than once."""
    digests = pages.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= MIN_REVISIT)
    return digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")


def write(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write one record for each row of ``page_id``, ``url``, ``html`` under ``path``."""
    body = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    groups = runtime.save(repeated_payloads(body), "warc-groups")
    small = groups.count() <= BROADCAST_GROUPS
    rows = body.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload")})
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), _escaped(F.col("url")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.lower(F.hex("digest")),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("first_id")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("n").cast("string")),
        F.lit(END),
    )
    out = rows.select(F.concat(header, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every magic line, in file order by (block, nth)."""
    cut = spark.read.option("lineSep", MAGIC).text(path)
    return cut.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def candidates(cut: DataFrame) -> DataFrame:
    """What each piece says of itself; ``digest`` only where its payload ends where the piece does."""
    size = F.octet_length("value")
    mark = F.instr("value", END)
    parsed = cut.select("file", "block", "nth", "value", size.cast("long").alias("n_bytes"), F.when((mark > 0) & F.col("value").startswith("WARC-Type: "), F.substring("value", F.lit(1), mark - 1)).alias("header"), mark.alias("mark"))
    length = F.regexp_extract("header", r"(?m)^Content-Length: ([0-9]{1,15})\r?$", 1)
    parsed = parsed.withColumns({"header_bytes": (F.octet_length("header") + len(END)).cast("long"), "declared": F.when(length != "", length.cast("long"))})
    whole = (F.col("n_bytes") == F.col("header_bytes") + F.col("declared") + len(END)) & F.col("value").endswith(END)
    payload = F.substring("value", F.col("mark") + len(END), F.length("value") - F.col("mark") - (2 * len(END) - 1))
    return parsed.select("file", "block", "nth", "n_bytes", "header", "header_bytes", "declared", F.when(whole, F.sha2(payload, 256)).alias("digest"))


def jump(succ: np.ndarray, start: int) -> np.ndarray:
    """Which nodes are reached from ``start`` along ``succ`` (-1: none), by doubling."""
    n = len(succ)
    step = np.where(succ < 0, n, succ)
    step = np.append(step, n)
    reached = np.zeros(n + 1, bool)
    reached[start] = True
    count = 0
    while (now := int(reached.sum())) != count:
        count = now
        reached[step[np.flatnonzero(reached)]] = True
        step = step[step]
    return reached[:n]


RECORD = "file string, at bigint, ends bigint, header string, header_bytes bigint, declared bigint, digest string, parts array<bigint>"


def verified(found: DataFrame) -> DataFrame:
    """The records of each file that the chain from its start reaches, with the content offsets of their pieces.

    A group is one file's pieces without their contents: the writer bounds them.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("nth", "ascending")])
        size = table["n_bytes"].to_numpy()
        content = np.cumsum(size + len(MAGIC)) - size - len(MAGIC)
        own, declared = table["header_bytes"].to_numpy(), table["declared"].to_numpy()
        good = np.array(table["header"].is_valid()) & np.array(table["declared"].is_valid()) & (content >= len(MAGIC))
        cand = np.flatnonzero(good)
        at = content[cand] - len(MAGIC)
        ends = at + len(MAGIC) + own[cand].astype(np.int64) + declared[cand].astype(np.int64) + len(END)
        spot = np.minimum(np.searchsorted(at, ends), max(len(at) - 1, 0))
        succ = np.where(at[spot] == ends, spot, -1) if len(at) else np.zeros(0, np.int64)
        kept = np.flatnonzero(jump(succ, 0)) if len(at) and at[0] == 0 else np.zeros(0, np.int64)
        rows = table.take(pa.array(cand[kept]))
        first = np.searchsorted(content, at[kept] + len(MAGIC))
        last = np.searchsorted(content, ends[kept])
        parts = [content[a:b].tolist() if b - a > 1 else None for a, b in zip(first, last, strict=True)]
        return pa.table({"file": rows["file"], "at": pa.array(at[kept], pa.int64()), "ends": pa.array(ends[kept], pa.int64()), "header": rows["header"], "header_bytes": rows["header_bytes"], "declared": rows["declared"], "digest": rows["digest"], "parts": pa.array(parts, pa.list_(pa.int64()))})

    return found.groupBy("file").applyInArrow(one, RECORD)


def rejoined(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """Digests of the payloads that magic lines inside them have cut in pieces."""
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi")
    placed = placed.withColumn("content", F.coalesce(F.sum(F.octet_length("value") + len(MAGIC)).over(order), F.lit(0)).cast("long"))
    wanted = broken.select("file", "at", "header_bytes", "declared", F.posexplode("parts").alias("k", "content"))
    joined = wanted.join(placed.select("file", "content", "value"), ["file", "content"])
    texts = joined.groupBy("file", "at", "header_bytes", "declared").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    body = F.array_join(F.transform("v", lambda x: x["value"]), MAGIC).cast("binary")
    payload = F.substring(body, (F.col("header_bytes") + 1).cast("int"), F.col("declared").cast("int"))
    return texts.select("file", "at", F.sha2(payload, 256).alias("whole_digest"))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, reached``: the files whose chain ends before they do, so that records after ``reached`` were not read."""
    cut = pieces(spark, path)
    # The first piece of a file stands before its first magic line, which every other piece has in front.
    size = cut.groupBy("file").agg((F.sum(F.octet_length("value") + len(MAGIC)) - len(MAGIC)).cast("long").alias("size"))
    ends = verified(candidates(cut)).groupBy("file").agg(F.max("ends").alias("reached"))
    return size.join(ends, "file", "left").withColumn("reached", F.coalesce("reached", F.lit(0).cast("long"))).where("reached < size")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, url, record_type, payload_bytes, payload_digest, refers_to."""
    records = runtime.save(verified(candidates(pieces(spark, path))), "warc-records")
    broken = records.where("parts is not null")
    field = lambda name: F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    urn = lambda name: number(F.regexp_extract("header", rf"(?m)^{name}: <urn:page:(-?[0-9]*)>", 1))
    if not broken.isEmpty():
        records = records.join(rejoined(spark, path, broken), ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "whole_digest"))
    kind = field("WARC-Type")
    url = field("WARC-Target-URI")
    for code, char in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        url = F.replace(url, F.lit(code), F.lit(char))
    return records.select(
        urn("WARC-Record-ID").alias("page_id"),
        url.alias("url"),
        F.when(kind == "revisit", number(field("X-Payload-Length"))).otherwise(F.col("declared")).alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_extract("header", r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]*)", 1)).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"),
    )


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.new_path(spark, "warc")
    write(runtime.table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
