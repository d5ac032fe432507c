"""Removal of benchmark passages from training text.

A window is ten consecutive words of a benchmark item, or all words of a
shorter one. The windows of a block of items go to every task as a hash set;
each task maps its documents' words to the block's vocabulary, hashes the
windows made of such words only, and compares each hit word by word. A
benchmark beyond ``BLOCK_WINDOWS`` is taken in several blocks, one pass over
the documents each, so that what is broadcast stays bounded.

Defined results: null and empty texts have no words and no hits; an item
without words hits nothing; an item without id is named by the empty string;
items that share an id count once; repeated documents are each scanned; extra
columns are carried along, those added replace columns of the same name; an
empty benchmark or an empty table of documents is no special case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brineflow import runtime

WINDOW = 10
#: Windows of one broadcast block at most (an item is never split).
BLOCK_WINDOWS = 200_000
BATCH_ROWS = 512
#: A document that loses more than this share of its words goes as a whole.
MAX_HIT_PERCENT = 50
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CASE = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bytes of UTF-8 to word bytes in lower case; all others to a blank.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Block:
    """The windows of some items: by length, hashes and the exact windows with their items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, list[str]]] = {}
        for name, text in items:
            words = words_of(text)
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            size = min(WINDOW, len(ids))
            for p in range(len(ids) - size + 1 if size else 0):
                found = self.exact.setdefault(size, {}).setdefault(ids[p : p + size].tobytes(), [])
                if name not in found:
                    found.append(name)
        self.hashes = {n: np.unique(self._hash(np.stack([np.frombuffer(w, np.int64) for w in ws]))) for n, ws in self.exact.items()}

    @staticmethod
    def _hash(windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            h = (h ^ windows[:, k].astype(np.uint64)) * _MUL
            h ^= h >> np.uint64(31)
        return h

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Word spans of the occurrences, with the items that hold them."""
        n = len(words)
        if not n or not self.exact:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, n)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        out = []
        for size, exact in self.exact.items():
            if n < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            windows = ids[at[:, None] + np.arange(size)]
            h, all_ = self._hash(windows), self.hashes[size]
            spot = np.minimum(np.searchsorted(all_, h), len(all_) - 1)
            for i in np.flatnonzero(all_[spot] == h).tolist():
                if (names := exact.get(windows[i].tobytes())) is not None:
                    out.append((int(at[i]), int(at[i]) + size, names))
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its words in the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_CASE))]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*parts, text[at:]])


def blocks_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_WINDOWS) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of ``most`` windows or so; only one block is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # An item has no more words than half its bytes and one.
    n = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    count = int(n // most) + 1
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k)
        yield [(r["name"], r["text"]) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, most: int = BLOCK_WINDOWS) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (word positions, start and end in turn), ``hit_items`` and ``clean_text`` (null without hits).

    ``carry``: the columns to keep, all by default.
    """
    spark = docs.sparkSession
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())]
    names = [f.name for f in added]
    rows = docs.drop(*names)
    keep = [c for c in (carry if carry is not None else rows.columns) if c not in names]
    rows = rows.select(*dict.fromkeys([*keep, "text"]))
    todo = blocks_of(benchmark, most=most)
    block, first = next(todo), True
    while block is not None:
        after = next(todo, None)
        rows = _scan(rows, spark.sparkContext.broadcast(block), added, keep if after is None else rows.columns, first)
        if after is not None:
            rows = runtime.save(rows, "decontaminate")
        block, first = after, False
    return rows


def _scan(rows: DataFrame, shared, added: list[T.StructField], keep: list[str], first: bool) -> DataFrame:
    own = [f for f in rows.schema.fields if f.name in keep and f.name not in {a.name for a in added}]
    schema = T.StructType([*own, *added])
    out_types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                known = [([], [])] * len(texts) if first else list(zip(batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(), batch.column(batch.schema.get_field_index("hit_items")).to_pylist(), strict=True))
                made: list[list] = [[], [], [], []]
                for text, (spans, items) in zip(texts, known, strict=True):
                    words = words_of(text)
                    hits = block.hits(words)
                    every = merge([*zip(spans[::2], spans[1::2], strict=True), *((a, b) for a, b, _ in hits)])
                    made[0].append(len(words))
                    made[1].append([x for s in every for x in s])
                    made[2].append(sorted({*items, *(i for _, _, names in hits for i in names)}))
                    made[3].append(without(text, every) if every else None)
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, t) for m, t in zip(made, out_types, strict=True))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def hit_words() -> Column:
    """Words in the spans: the ends less the starts."""
    return F.expr("aggregate(transform(hit_spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")


def remove(docs: DataFrame, benchmark: DataFrame, max_hit_percent: int = MAX_HIT_PERCENT) -> DataFrame:
    """The documents without benchmark passages; a document that is mostly such passages goes. Same columns."""
    found = find(docs, benchmark)
    kept = found.where(100 * hit_words() <= max_hit_percent * F.col("n_words"))
    return kept.withColumn("text", F.coalesce("clean_text", "text")).select(*docs.columns)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, runtime.table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )
