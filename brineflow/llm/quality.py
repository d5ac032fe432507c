"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; a line that more than ``max_docs`` documents
of one host (the ``source`` column) carry is boilerplate and is removed.
A document that loses more than half of its characters that way is rejected.

Defined results: a null text has no words and fails the length rule; a null
host is a host of its own; documents are told apart by id and text (a null id is an
id), so repeated rows count once for the lines and each get the same verdict; a blank
line is never boilerplate; extra columns are carried along by :func:`clean` and the columns
added replace those of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineflow import runtime

#: A word is a run of other characters than these (fixed value of the word rule).
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MAX_REMOVED_PERCENT = 50


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK, -1), lambda w: w != "")


def sorted_windows(words: Column) -> Column:
    """Hash and position of every 3-word window, sorted by hash.

    A hash equal to a neighbour's marks a window that occurs twice or more; the
    marked positions, in order, cover three words each less the overlap with the next.
    """
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))


def base_features(docs: DataFrame) -> DataFrame:
    """Add the per-document counts and ``base_failed``."""
    wide = docs.withColumn("__w", words_of(F.col("text")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = wide.withColumns({"n_words": F.size("__w").cast("long"), "__lines": lines, "__win": sorted_windows(F.col("__w"))})
    marked = """filter(transform(__win, (x, i) -> if(x.h <=> get(__win, i - 1).h or x.h <=> get(__win, i + 1).h, x.p, null)), p -> p is not null)"""
    wide = wide.withColumn("__marks", F.array_sort(F.expr(marked)))
    covered = """case when size(__marks) = 0 then 0 else 3 + aggregate(zip_with(slice(__marks, 2, size(__marks)), slice(__marks, 1, size(__marks) - 1), (b, a) -> least(3, b - a)), 0, (s, x) -> s + x) end"""
    wide = wide.withColumns({
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.coalesce(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, "")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(covered).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return wide.withColumn("base_failed", failed).drop("__w", "__win", "__marks", "__lines")


def normal_lines(text: Column) -> Column:
    """For every line its characters ``n`` and the hash ``h`` of it trimmed and in lower case; null where the line has no word."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(F.trim(F.lower(x))).alias("h"), F.length(x).alias("n"))))


def _key() -> list[Column]:
    """What tells rows apart: the id and the text, so that equal ids with other texts stay apart."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), F.xxhash64("text").alias("k_hash")]


def boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS, count_copies: bool = True) -> DataFrame:
    """``k_id, k_hash, lost_chars, bad_lines`` (their positions) of the documents with lines that more than ``max_docs`` distinct documents of their host carry.

    Without ``count_copies`` the documents of one text count as one. A document names each of its lines once,
    with all its places, and what is counted merges within each task before it is shuffled. The lines
    above the limit are then joined back, where Spark splits what a common line
    makes too large.
    """
    rows = docs.select(*_key(), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.posexplode(normal_lines(F.col("text"))).alias("at", "line"))
    lines = rows.where("line is not null").select("k_id", "k_hash", "host", "line.h", F.struct("at", "line.n").alias("place"))
    named = F.xxhash64("k_id", "k_hash") if count_copies else F.col("k_hash")
    above = lines.groupBy("host", "h").agg(F.count_distinct(named).alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "h")
    # A document's own lines meet here; rows that repeat it name the same places.
    lost = lines.join(above, ["host", "h"], "left_semi").groupBy("k_id", "k_hash").agg(F.collect_set("place").alias("places"))
    return lost.select("k_id", "k_hash", F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("lost_chars"), F.transform("places", lambda p: p["at"].cast("long")).alias("bad_lines"))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, count_copies: bool = True) -> DataFrame:
    """All rows with the counts, ``kept``, and ``clean_text``: the text without its boilerplate lines."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "bad_lines", "lost_chars", "k_id", "k_hash")
    lost = boilerplate(docs, max_docs, count_copies)
    rows = base_features(docs).withColumns({c: k for c, k in zip(("k_id", "k_hash"), _key(), strict=True)})
    joined = rows.join(lost, ["k_id", "k_hash"], "left")
    depleted = 100 * F.col("lost_chars") > MAX_REMOVED_PERCENT * F.length(F.replace("text", F.lit("\n"), F.lit("")))
    # The difference of two sets of numbers is made by hashing, in one pass over each.
    good = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__lines").cast("long") - 1), "bad_lines")
    joined = joined.withColumn("__lines", F.split("text", "\n", -1)).withColumns({
        "kept": ~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False)),
        "clean_text": F.when(F.col("bad_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(good, lambda i: F.get("__lines", i.cast("int"))), "\n")),
    })
    return joined.drop("k_id", "k_hash", "bad_lines", "lost_chars", "__lines")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
