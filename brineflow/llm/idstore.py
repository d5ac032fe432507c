"""Token ids as raw binary shards with a keyed index.

A shard is two files: ``.ids``, the ids of its documents one after the other in
ascending key order, as little-endian unsigned integers of 16 or 32 bits with
no header; and ``.idx``, numpy arrays: the documents in order (key, first id,
count) and, for keyed access in constant time, a minimal perfect hash over the
keys with a 32-bit fingerprint and the document's row by slot.

Each task sorts its range of keys, streams the ids to a file of its own name in
the shared folder and returns the shard's manifest row, so a repeated task
writes anew and only the files of the task that succeeded are named.

Defined results: a null or empty text has the end id alone; a null key sorts
first and is stored but not indexed; of rows that share a key all are stored,
ordered by a hash of the text, and keyed access gives the first; an empty table gives no
shards and no rows. Other columns are not stored.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.llm.chunks import encode_column
from brineflow.llm.mph import PerfectHash, mix

END_ID = 2
#: Documents that are encoded together.
BATCH_ROWS = 8192
#: Words of plain letters with simple signs or single line ends between them: a match ends wherever one gives way to the other.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORDS = re.compile(rf"[{_LETTERS}]+(?:(?:[.,!?;:]+\n?|\n)[{_LETTERS}]*)*")
_PART = re.compile(rf"[{_LETTERS}]+|[.,!?;:]+\n?|\n")
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint"
NULL_KEY = np.iinfo(np.int64).min


class LibraryEncoder:
    """Whole texts by the tokenizers library, which sees each distinct piece once while it is remembered.

    New pieces are encoded as one text, since a match starts at each; where a
    piece's ids end follows from the bytes that each id stands for.
    """

    def __init__(self, blob: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.width = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(added[i].encode()) if i in added else len(token)  # a token has one sign for each byte
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = most

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id: a vocabulary names a byte that is no visible Latin sign by one of the signs from 256 on, in order."""
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        back = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        out = [b""] * len(self.n_bytes)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(map(back.__getitem__, token))
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = t.content.encode()
        return out

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.asarray(made.ids, self.width)

    def _joined(self, words: list[str]) -> None:
        """Encode pieces as one text, since a match starts at the space before each."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = next(self._ids([" " + " ".join(some)]))
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in some])) + 1
            raw, size, last = ids.tobytes(), self.width.itemsize, 0
            for w, end in zip(some, (ends * size).tolist(), strict=True):
                self.known[w] = raw[last:end]
                last = end

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces; a word with signs or lines after it by its parts, which occur in many pieces."""
        plain, split = [], {}
        for p in pieces:
            if not p.isalpha() and _WORDS.fullmatch(p) and "\n\n" not in p:
                split[p] = _PART.findall(p)
                plain.append(split[p][0])
            else:
                plain.append(p)
        self._joined([w for w in dict.fromkeys(plain) if w not in self.known])
        rest = list({w for ws in split.values() for w in ws[1:] if w not in self.parts})
        self.parts |= zip(rest, self._first(rest), strict=True)
        for p, ws in split.items():
            self.known[p] = self.known[ws[0]] + b"".join(map(self.parts.__getitem__, ws[1:]))
        if len(self.parts) > self.most:
            self.parts.clear()

    def _first(self, pieces: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._ids(pieces)]

    def _later(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        lost = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in lost:
            if (v := self.older.get(pieces[i])) is None:
                new.append(pieces[i])
            else:
                self.known[pieces[i]] = v
        self.learn(new)
        for i in lost:
            found[i] = self.known[pieces[i]]
        return found

    def encode(self, column: pa.Array) -> list[bytes]:
        # Two generations: what is asked for again comes back from the older.
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        return encode_column(column, self._first, self._later)


_ENCODERS: dict[int, LibraryEncoder] = {}


def encoder_of(blob: str) -> LibraryEncoder:
    key = zlib.crc32(blob.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(blob)
    return _ENCODERS[key]


def _index(keys: np.ndarray, counts: np.ndarray, width: np.dtype) -> bytes:
    starts = np.cumsum(counts) - counts
    own, row = np.unique(keys, return_index=True)
    own, row = own[own != NULL_KEY], row[own != NULL_KEY]
    hashed = PerfectHash.build(own.view(np.uint64))
    slots = hashed.slots(own.view(np.uint64))
    marks, rows = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64)
    marks[slots], rows[slots] = _fingerprint(own), row
    out = io.BytesIO()
    np.savez(out, keys=keys, starts=starts, counts=counts, width=width.itemsize, sizes=np.asarray(hashed.sizes, np.int64), words=hashed.words, before=hashed.before, marks=marks, rows=rows)
    return out.getvalue()


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), 0x5EED) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard's index, and its ids by key or by row."""

    def __init__(self, path: str):
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(base + ".idx") as f:
            self.a = dict(np.load(io.BytesIO(f.read())))
        self.hash = PerfectHash(self.a["sizes"].tolist(), self.a["words"], self.a["before"])
        self.width = np.dtype(f"<u{int(self.a['width'])}")
        self.file = fs.open_input_file(base + ".ids")

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 where the fingerprint or the stored key says that it isn't here."""
        keys = np.asarray(keys, np.int64)
        slots = self.hash.slots(keys.view(np.uint64))
        known = slots >= 0
        known[known] = self.a["marks"][slots[known]] == _fingerprint(keys[known])
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.a["rows"][slots[known]]
        found = np.flatnonzero(known)
        out[found[self.a["keys"][out[found]] != keys[found]]] = -1
        return out

    def read(self, row: int) -> np.ndarray:
        size, at = self.width.itemsize, int(self.a["starts"][row])
        self.file.seek(at * size)
        return np.frombuffer(self.file.read(int(self.a["counts"][row]) * size), self.width)

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.rows_of(np.asarray([key]))[0])
        return None if row < 0 else self.read(row)


def write(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents as shards in ascending key order; returns the manifest with each shard's first id."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())  # the vocabulary: a file of a few MB
    folder = runtime.new_path(spark, "ids")
    order = ["key", "tie"]
    ranged = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(blob.value)
        fs, base = pafs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        name = f"{base}/shard-{number:05d}-{uuid.uuid4().hex[:8]}"
        keys, counts, out = [], [], None
        end = np.asarray([end_id], encoder.width).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(name + ".ids")
                keys.append(part.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
                sizes = []
                for ids in encoder.encode(part.column(1)):
                    out.write(ids + end)
                    sizes.append(len(ids) // encoder.width.itemsize + 1)
                counts.append(np.asarray(sizes, np.int64))
        if out is None:
            return
        out.close()
        all_keys, all_counts = np.concatenate(keys).astype(np.int64), np.concatenate(counts)
        with fs.open_output_stream(name + ".idx") as f:
            f.write(_index(all_keys, all_counts, encoder.width))
        own = all_keys[all_keys != NULL_KEY]
        ends = {"first_key": int(own[0]), "last_key": int(own[-1])} if len(own) else {"first_key": None, "last_key": None}
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"{folder}/{name.rsplit('/', 1)[1]}", "n_docs": len(all_keys), "n_ids": int(all_counts.sum()), **ends}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "first_key", "last_key"))]))

    manifest = runtime.save(ranged.mapInArrow(run, MANIFEST), "ids-manifest")
    # One row for each shard; the running sum over them is all that is needed for global offsets.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def holders(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Each ``key`` with the shards whose range of keys holds it: one, or several where a repeated key spans them. The manifest has one row for each shard."""
    return keys.join(F.broadcast(manifest.select("shard", "path", "first_key", "last_key")), F.col("key").between(F.col("first_key"), F.col("last_key"))).select("key", "shard", "path")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, through the index: key, start, n_tokens and the ids' checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                keys, starts, counts = shard.a["keys"], shard.a["starts"], shard.a["counts"]
                rows = np.arange(len(keys))
                once = np.ones(len(keys), bool)
                once[1:] = keys[1:] != keys[:-1]
                once &= keys != NULL_KEY
                rows[once] = shard.rows_of(keys[once])
                for at in range(0, len(rows), BATCH_ROWS):
                    some = rows[at : at + BATCH_ROWS]
                    sums = [zlib.crc32(shard.read(r).astype("<u4").tobytes()) for r in some.tolist()]
                    own = keys[some]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL_KEY), pa.array(starts[some] + row["first_id"], pa.int64()), pa.array(counts[some], pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    # An explicit number: Spark would put so few rows into one task.
    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read(manifest).withColumnRenamed("key", "doc_id")
