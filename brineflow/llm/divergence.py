"""Audit of how far the sources of a language differ in their words.

Each language keeps the terms that enough of its documents hold. For a group
(language and source) a kept term has the share p = 1 + floor(10**9 (count + 5)
/ (N + 5 V)), N being the group's occurrences of kept terms and V the number of
kept terms; two sources are as far apart as the sum of |p - q| over all terms.

The sum is split. Terms that many groups of the language hold are laid out as
dense tiles, sources by terms, in blocks, and numpy adds the differences up.
For rare terms nearly all shares are the group's base, that of count 0: the
difference of the bases is taken for every term, a histogram of each group's
own shares corrects it for the rare terms that only one of the two holds, and
the short posting list of a term corrects the pairs within it. All sums are of
whole numbers, so they add up exactly.

Defined results: null text, language and source are empty strings; a group
without terms has the base share for all; a language without kept terms has
the value 0 for each pair and no rows of terms; a language with one source has
no pairs; repeated rows each count; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow import runtime

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
RANKS = 50
#: A term in more groups of its language than these is dense.
LIGHT_GROUPS = 6
#: Sources and, about, terms of one dense tile.
TILE_SOURCES, TILE_TERMS = 256, 1024
#: Bytes of text that a task works on at once; a longer text is taken alone.
PIECE_BYTES = 16 << 20
#: Bytes of UTF-8 to those of terms in lower case; 0 for all others.
_BYTE = np.asarray([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of all texts in a row, and how many each text has."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _BYTE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data and len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = raw != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]  # a text starts anew even where the text before ends in a term
    starts[edge] = inside[edge]
    first = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int64) - inside
    ends = np.append(before[first], inside.sum()).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(raw[inside]))
    return np.diff(np.searchsorted(first, bounds)), terms


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, done + PIECE_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        sizes, terms = terms_of(piece.column(2))
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        langs, sources = piece.column(0).dictionary_encode(), piece.column(1).dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        k = len(names)
        per_doc, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + codes, return_counts=True)
        key, place = np.unique(group[per_doc // k] * k + per_doc % k, return_inverse=True)
        lang, source = np.divmod(key // k, len(sources.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang)).cast(pa.string()),
                sources.dictionary.take(pa.array(source)).cast(pa.string()),
                names.take(pa.array(key % k)).cast(pa.string()),
                pa.array(np.bincount(place, n).astype(np.int64)),
                pa.array(np.bincount(place)),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``docs``; merged within a task's pieces, then by Spark."""
    found = docs.select(_text("lang"), _text("source"), _text("text")).mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), three digits at a time so that nothing leaves 64 bits; ``count`` <= ``total``."""
    quotient, rest = F.expr("0L"), count
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + _div(rest, total), rest % total
    return quotient + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The counts of the terms that at least ``least`` documents of the language hold, with ``lang_n`` and ``n_groups`` of the term in the language."""
    known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"), F.count("*").alias("n_groups"))
    return counts.drop("docs").join(known.where(F.col("in_docs") >= least).drop("in_docs"), ["lang", "term"])


def groups_of(docs: DataFrame, kept: DataFrame, light_groups: int = LIGHT_GROUPS) -> DataFrame:
    """Every (lang, source): its number ``idx`` in the language, ``n_group``, ``lang_total``, ``v``, ``light`` terms and its ``base`` share (0 if v = 0)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"), F.first("n_groups").alias("n_groups"))
    langs = terms.groupBy("lang").agg(
        F.count("*").alias("v"),
        F.sum("lang_n").alias("lang_total"),
        F.count_if(F.col("n_groups") <= light_groups).alias("light"),
    )
    every = docs.select(_text("lang"), _text("source")).distinct()
    rows = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "v", "lang_total", "light"])
    base = F.when(F.col("v") > 0, share(F.lit(SMOOTHING).cast("long"), F.col("n_group") + SMOOTHING * F.col("v"))).otherwise(0)
    return rows.withColumns({"base": base, "idx": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})


def _dense(heads: pa.Table, rows: pa.Table) -> np.ndarray:
    """What the block's terms add to the difference of the bases, for sources of tile a (rows) and b (columns); a source that lacks a term has its base."""
    coded = rows.column("term").combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    width = heads["width"][0].as_py()
    bases = [np.asarray(heads[c][0].as_py(), np.int64) for c in ("bases_a", "bases_b")]
    idx, p, out = rows.column("idx").to_numpy(), rows.column("p").to_numpy(), []
    for tile, base in zip((heads["tile_a"][0].as_py(), heads["tile_b"][0].as_py()), bases, strict=True):
        shares = np.repeat(base[:, None], len(terms), 1)
        own = idx // width == tile
        shares[idx[own] % width, code[own]] = p[own]
        out.append(shares)
    # Terms of the block that neither tile holds are left at the difference of the bases.
    return np.stack([np.abs(out[1] - a).sum(1) for a in out[0]]) - len(terms) * np.abs(bases[0][:, None] - bases[1][None, :])


def _one_sided(heads: pa.Table, rows: pa.Table) -> np.ndarray:
    """The difference of the bases for all terms, corrected for the rare terms of either source as if the other lacked them."""
    tiles, width = (heads["tile_a"][0].as_py(), heads["tile_b"][0].as_py()), heads["width"][0].as_py()
    bases = [np.asarray(heads[c][0].as_py(), np.int64) for c in ("bases_a", "bases_b")]
    apart = np.abs(bases[0][:, None] - bases[1][None, :])
    total = heads["v"][0].as_py() * apart
    idx, p, m = (rows.column(c).to_numpy() for c in ("idx", "p", "n_terms"))
    for side in (0, 1):
        other = bases[1 - side]
        for s in np.unique(idx[idx // width == tiles[side]]).tolist():
            of = np.flatnonzero(idx == s)
            of = of[np.argsort(p[of])]
            values = p[of]
            count, mass = np.concatenate([[0], np.cumsum(m[of])]), np.concatenate([[0], np.cumsum(m[of] * values)])
            below = np.searchsorted(values, other)
            sums = other * count[below] - mass[below] + (mass[-1] - mass[below]) - other * (count[-1] - count[below])
            at = s % width
            if side == 0:
                total[at, :] += sums - count[-1] * apart[at, :]
            else:
                total[:, at] += sums - count[-1] * apart[:, at]
    return total


def _tile(heads: pa.Table, rows: pa.Table) -> pa.Table:
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])
    if not heads.num_rows:  # rows have heads
        return schema.empty_table()
    total = (_one_sided if heads["block"][0].as_py() < 0 else _dense)(heads, rows)
    a, b = np.indices(total.shape)
    width = heads["width"][0].as_py()
    a, b = a.ravel() + heads["tile_a"][0].as_py() * width, b.ravel() + heads["tile_b"][0].as_py() * width
    ahead = a < b
    lang = pa.array([heads["lang"][0].as_py()] * int(ahead.sum()), pa.string())
    return pa.table([lang, pa.array(a[ahead], pa.int32()), pa.array(b[ahead], pa.int32()), pa.array(total.ravel()[ahead])], schema=schema)


def pair_sums(kept: DataFrame, groups: DataFrame, light_groups: int = LIGHT_GROUPS, tile_sources: int = TILE_SOURCES, tile_terms: int = TILE_TERMS) -> DataFrame:
    """``lang``, ``a`` < ``b`` (numbers of sources) and ``value``, the sum of |p - q| over all kept terms. ``kept`` has ``idx``, ``p`` and ``base``."""
    heavy, light = kept.where(F.col("n_groups") > light_groups), kept.where(F.col("n_groups") <= light_groups)
    tile = F.floor(F.col("idx") / tile_sources).cast("int")
    # A tile's bases: ``tile_sources`` numbers at most. Block -1 holds the rare terms.
    tiles = groups.groupBy("lang", tile.alias("tile")).agg(F.array_sort(F.collect_list(F.struct("idx", "base"))).alias("bases"), F.max("light").alias("light"), F.max("v").alias("v"))
    tiles = tiles.withColumns({"bases": F.col("bases.base"), "blocks": F.ceil((F.col("v") - F.col("light")) / tile_terms).cast("int")})
    a = tiles.select("lang", F.col("tile").alias("tile_a"), F.col("bases").alias("bases_a"), "v", "blocks")
    heads = a.join(tiles.select("lang", F.col("tile").alias("tile_b"), F.col("bases").alias("bases_b")), "lang").where("tile_a <= tile_b")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(-1), F.col("blocks") - 1))).withColumn("width", F.lit(tile_sources))
    number = groups.groupBy("lang").agg((F.floor(F.max("idx") / tile_sources) + 1).cast("int").alias("n_tiles"), F.first(F.ceil((F.col("v") - F.col("light")) / tile_terms).cast("int")).alias("blocks"))
    dense = heavy.join(number, "lang").select("lang", "idx", F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int").alias("block"), "term", "p", F.lit(1).cast("long").alias("n_terms"), "n_tiles")
    histogram = light.groupBy("lang", "idx", "p").agg(F.count("*").alias("n_terms")).join(number, "lang")
    rows = dense.unionByName(histogram.select("lang", "idx", F.lit(-1).alias("block"), F.lit("").alias("term"), "p", "n_terms", "n_tiles"))
    rows = rows.select("lang", "block", "idx", "term", "p", "n_terms", tile.alias("own"), F.explode(F.expr("sequence(0, n_tiles - 1)")).alias("other"))
    rows = rows.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")}).drop("own", "other")
    keys = ["lang", "block", "tile_a", "tile_b"]
    parts = heads.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_tile, "lang string, a int, b int, value bigint")
    # ``light_groups`` entries at most in a list.
    listed = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "base"))).alias("post"))
    pairs = listed.select("lang", F.explode(F.expr("flatten(transform(post, (x, i) -> transform(slice(post, i + 2, size(post)), y -> struct(x, y))))")).alias("xy"))
    x, y = F.col("xy.x"), F.col("xy.y")
    shared = F.abs(x["p"] - y["p"]) - F.abs(x["p"] - y["base"]) - F.abs(x["base"] - y["p"]) + F.abs(x["base"] - y["base"])
    postings = pairs.select("lang", x["idx"].alias("a"), y["idx"].alias("b"), shared.alias("value"))
    return parts.unionByName(postings).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, light_groups: int = LIGHT_GROUPS, tile_sources: int = TILE_SOURCES, tile_terms: int = TILE_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair, term), ``item``, ``value``, ``rank``."""
    counts = runtime.save(term_counts(docs), "term-counts")
    kept = runtime.save(kept_terms(counts, least), "kept-terms")
    groups = runtime.save(groups_of(docs, kept, light_groups), "term-groups")
    smooth = SMOOTHING * F.col("v")
    shares = kept.join(groups, ["lang", "source"]).withColumns({
        "p": share(F.col("n") + SMOOTHING, F.col("n_group") + smooth),
        "q": share(F.col("lang_n") + SMOOTHING, F.col("lang_total") + smooth),
    })
    sums = pair_sums(shares, groups, light_groups, tile_sources, tile_terms)
    names = groups.select("lang", F.col("idx").alias("a"), "source")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pair = both.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pair.unionByName(term)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(runtime.table(spark, sf_dir, "documents").select("text", "lang", "source"))
