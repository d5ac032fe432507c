"""Byte-level BPE encoding and decoding over a rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that
is a token itself; any other is merged with a heap of (rank, position) over a
linked list of its bytes, lowest rank first and leftmost among equals.

Defined results: a null or empty text has no ids and decodes to no bytes; the
texts are encoded whole; repeated rows are each encoded; extra columns are
carried along and the columns added replace those of the same name.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brineflow import runtime
from brineflow.llm.chunks import KEPT, Memo, encode_column, forget
from brineflow.llm.mph import PerfectHash

#: Rows that one returned batch holds at most.
BATCH_ROWS = 512
#: Bytes of what a worker remembers of pieces seen before: beside other work, and where encoding has the executors to itself.
MEMO_BYTES, WIDE_MEMO_BYTES = 80 << 20, 384 << 20


class Vocabulary:
    """Tokens by slot of the perfect hash; as large as the rank file, whatever the corpus."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        self.pattern = pattern
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        self.hash = PerfectHash.build(keys)
        slots = self.hash.slots(keys).tolist()
        self.tokens, self.ids = [b""] * len(tokens), [0] * len(tokens)
        for s, t, i in zip(slots, tokens, ids, strict=True):
            self.tokens[s], self.ids[s] = t, i
        self.by_id = dict(zip(ids, tokens, strict=True))
        #: Ranks of the pairs that merging asks for, most of which are no tokens.
        self.ranks = dict(zip(tokens, ids, strict=True))
        self.key = xxhash.xxh3_64_hexdigest(b"\0".join(tokens) + pattern.encode())

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls([base64.b64decode(t) for t, _ in pairs], [int(i) for _, i in pairs], pattern)

    def find(self, raw: list[bytes]) -> list[int | None]:
        """The id of each that is a token, by its slot of the perfect hash."""
        slots = self.hash.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))).tolist()
        return [self.ids[s] if s >= 0 and self.tokens[s] == r else None for s, r in zip(slots, raw, strict=True)]


class Codec:
    def __init__(self, vocabulary: Vocabulary, memo_bytes: int = MEMO_BYTES):
        self.v = vocabulary
        self.match = regex.compile(vocabulary.pattern).findall
        self.pre = Memo(self._pre_tokens, memo_bytes // 4)
        self.first = Memo(self._pieces, memo_bytes // 8)
        self.later = Memo(lambda pieces: self._pieces([" " + p for p in pieces]), memo_bytes // 2)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by their pre-tokens, each of which is looked up once."""
        parts = list(map(self.match, pieces))
        distinct = list(dict.fromkeys(t for p in parts for t in p))
        known = dict(zip(distinct, self.pre(distinct), strict=True)).__getitem__
        return [known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for p in parts]

    def _pre_tokens(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return [i.to_bytes(4, "little") if i is not None else self.merge(r) for r, i in zip(raw, self.v.find(raw), strict=True)]

    def merge(self, raw: bytes) -> bytes:
        """The ids of a pre-token that is no token itself, its bytes merged."""
        n = len(raw)
        rank = self.v.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
        back = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                back[stop] = i
                if (r := rank(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := rank(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(rank(raw[i : end[i]]))
            i = end[i]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return encode_column(column, self.first, self.later)

    def decode(self, column: pa.Array) -> list[bytes]:
        find = self.v.by_id.__getitem__
        return [b"".join(map(find, np.frombuffer(ids or b"", "<u4").tolist())) for ids in column.to_pylist()]


def codec_of(vocabulary: Vocabulary, memo_bytes: int = MEMO_BYTES) -> Codec:
    """One for each worker process, vocabulary and bound, so that its memo outlives a task."""
    name = f"{vocabulary.key} {memo_bytes}"
    if name not in KEPT:
        forget()
        KEPT[name] = Codec(vocabulary, memo_bytes)
    return KEPT[name]


def _with_columns(df: DataFrame, source: str, made: dict) -> DataFrame:
    """Add binary columns: ``made`` names each and gives its values from the codec, the source column and the columns made before."""
    df = df.drop(*(c for c in made if c != source))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.BinaryType()) for c in made)])
    at = df.columns.index(source)
    steps = list(made.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                columns = [part.column(at)]
                for step in steps:
                    columns.append(pa.array(step(columns[-1]), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns[1:]], names=schema.names)

    return df.mapInArrow(run, schema)


def share(spark: SparkSession, path: str, pattern: str):
    """Broadcast a vocabulary: its size is that of the rank file, a few MB."""
    return spark.sparkContext.broadcast(Vocabulary.load(path, pattern))


def encode(docs: DataFrame, shared, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text as little-endian unsigned 32-bit integers."""
    return _with_columns(docs, text, {out: lambda c: codec_of(shared.value).encode(c)})


def decode(rows: DataFrame, shared, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for."""
    return _with_columns(rows, ids, {out: lambda c: codec_of(shared.value).decode(c)})


def encode_and_decode(docs: DataFrame, shared, text: str = "text", ids: str = "token_ids", out: str = "decoded", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Both, one after the other in one worker: the ids, and the bytes that they stand for."""
    return _with_columns(docs, text, {ids: lambda c: codec_of(shared.value, memo_bytes).encode(c), out: lambda c: codec_of(shared.value, memo_bytes).decode(c)})


def default_vocabulary(spark: SparkSession):
    import public_tokenizers

    return share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = default_vocabulary(spark)
    return encode_and_decode(docs, shared, memo_bytes=WIDE_MEMO_BYTES).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
