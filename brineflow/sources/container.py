"""The packed container of water surfaces: one gzip file of a header and, for each phase, stages times slots.

Raw bytes: the magic, the header's length as a little-endian 32-bit integer, the
header as JSON, the phases' arrays. The header's ``phaseArrays`` maps each phase to
its ``offset`` after the header and its ``length``; slot 0 of a row is no zone. With
``valueType`` ``int16-le`` a slot is hundredths, dry as ``drySentinel``; else it is one
byte of tenths over ``surfaceOffsetDecifeet``.

All offsets follow from the number of stages and zones, so a container is written
in blocks: tasks fill and compress a block each, as gzip members, and one task
copies the members, in order, into the file. A member says its size in its extra
field, which gzip readers skip, so that members are found without unpacking those
before them and are read by tasks of their own; a file without it is unpacked in order.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import runtime

#: First bytes and value of a dry slot (fixed values).
MAGIC = b"NWHYD2\0\0"
DRY = -32768
PHASES = ("filling", "slack", "draining")
#: Slots of a block, two bytes each.
BLOCK_SLOTS = 1 << 20
#: States that a task packs at once on their way to the blocks.
PIECE_STATES = 1 << 21
STATE = "phase string, stage int, zone_id int, surface_c int"
#: A member's start: fixed bytes, then the extra field with the member's size.
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\x02\xff" + struct.pack("<H", 12) + b"NW" + struct.pack("<H", 8)


def header_of(meta: dict, n_stages: int, n_zones: int) -> bytes:
    """The header with all that follows from the numbers of stages and zones."""
    length = n_stages * (n_zones + 1) * 2
    own = {"phaseOrder": list(PHASES), "stageCount": n_stages, "zoneStride": n_zones + 1, "valueType": "int16-le", "drySentinel": DRY}
    own["phaseArrays"] = {p: {"offset": k * length, "length": length} for k, p in enumerate(PHASES)}
    return json.dumps(meta | own, separators=(",", ":")).encode()


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member that says its own size."""
    deflate = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(raw) + deflate.flush()
    return HEAD + struct.pack("<Q", len(HEAD) + 8 + len(body) + 8) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def members(states: DataFrame, n_stages: int, n_zones: int, meta: dict, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """``block, content``: gzip members that make up the container in order of ``block``; the header is block -1.

    ``states``: phase, stage (its number), zone_id, surface_c; a null surface or one that is not there is dry, and of
    surfaces of one slot the highest counts.
    """
    spark = states.sparkSession
    total = len(PHASES) * n_stages * (n_zones + 1)
    header = header_of(meta, n_stages, n_zones)
    row = F.coalesce(*(F.when(F.col("phase") == p, k) for k, p in enumerate(PHASES)), F.raise_error(F.lit("no such phase"))).cast("long")
    slot = ((row * n_stages + F.col("stage")) * (n_zones + 1) + F.col("zone_id") + 1).alias("slot")
    given = states.where("surface_c is not null").select(slot, F.least(F.lit(32767), F.greatest(F.lit(-32767), "surface_c")).cast("short").alias("v"))
    n_blocks = -(-total // block_slots)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots and values of each block as bytes: what goes to the blocks is a few rows, not one for each state."""

        def packed() -> pa.RecordBatch:
            slots, values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(slots, kind="stable")
            slots, values = slots[order], values[order]
            block = slots // block_slots
            first = np.flatnonzero(np.diff(block, prepend=-1))
            at = (slots - block * block_slots).astype("<i4")
            parts = [slice(i, j) for i, j in zip(first, [*first[1:], len(slots)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array([at[p].tobytes() for p in parts], pa.binary()), pa.array([values[p].tobytes() for p in parts], pa.binary())], ["block", "at", "v"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<i2")))
                n += batch.num_rows
            if n >= PIECE_STATES:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    # A marker for each block, so that a block in which all is dry is made too.
    empty = F.lit(b"").cast("binary")
    every = spark.range(n_blocks).select(F.col("id").alias("block"), empty.alias("at"), empty.alias("v"))
    dealt = given.mapInArrow(pack, "block bigint, at binary, v binary").unionByName(every)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full(min(block_slots, total - int(key[0]) * block_slots), DRY, "<i2")
        np.maximum.at(out, np.frombuffer(b"".join(rows["at"]), "<i4"), np.frombuffer(b"".join(rows["v"]), "<i2"))
        return pd.DataFrame({"block": [int(key[0])], "content": [member(out.tobytes())]})

    made = dealt.groupBy("block").applyInPandas(fill, "block bigint, content binary")
    head = member(MAGIC + struct.pack("<I", len(header)) + header)
    return made.unionByName(spark.createDataFrame([(-1, bytearray(head))], "block bigint, content binary"))


def write(states: DataFrame, path: str, n_stages: int, n_zones: int, meta: dict, block_slots: int = BLOCK_SLOTS) -> None:
    """Write the container to ``path`` on any shared file system; it is there when it is whole."""
    spark = states.sparkSession
    blocks = runtime.save(members(states, n_stages, n_zones, meta, block_slots), "container-members")
    aside = f"{path}.{uuid.uuid4().hex[:8]}"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, name = pafs.FileSystem.from_uri(aside)
        size = 0
        with fs.open_output_stream(name) as out:
            for batch in batches:
                for content in batch.column(1):
                    size += content.as_buffer().size
                    out.write(content.as_buffer())
        fs.move(name, pafs.FileSystem.from_uri(path)[1])
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], ["bytes"])

    # One file has one writer: it copies compressed bytes, a batch at a time.
    blocks.repartition(1).sortWithinPartitions("block").mapInArrow(join, "bytes bigint").collect()
    runtime.drop(blocks)


def surfaces(content: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
    """Phase, stage and hundredths by zone of each row, one row in memory at a time."""
    return _surfaces(io.BytesIO(content))


def _header(z) -> dict:
    if z.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a state container")
    return json.loads(z.read(struct.unpack("<I", z.read(4))[0]))


def _arrays(meta: dict, width: int) -> list[tuple[str, int, int]]:
    """Phase, offset and length of the arrays in the file's order."""
    arrays, at = sorted(((phase, a["offset"], a["length"]) for phase, a in meta["phaseArrays"].items()), key=lambda x: x[1]), 0
    for phase, offset, length in arrays:
        if length != meta["stageCount"] * width or offset < at:
            raise ValueError(f"the array of {phase} does not fit the header")
        at = offset + length
    return arrays


def _surfaces(file) -> Iterator[tuple[str, int, np.ndarray]]:
    with gzip.GzipFile(fileobj=file) as z:
        meta = _header(z)
        stages, wide = meta["stageCount"], meta.get("valueType") == "int16-le"
        width, at = meta["zoneStride"] * (2 if wide else 1), 0
        for phase, offset, length in _arrays(meta, width):
            z.read(offset - at)
            for stage in range(stages):
                raw = z.read(width)
                if len(raw) != width:
                    raise ValueError("the container is cut short")
                if wide:
                    values = np.frombuffer(raw, "<i2").astype(np.int32)
                else:
                    code = np.frombuffer(raw, np.uint8).astype(np.int32)
                    values = np.where(code == meta["drySentinel"], DRY, (code + meta["surfaceOffsetDecifeet"]) * 10)
                yield phase, stage, values[1:]
            at = offset + length


def _wet(phase: str, stage: np.ndarray, zone: np.ndarray, surface: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(phase), len(zone)), *(pa.array(c.astype(np.int32)) for c in (stage, zone, surface))]
    return pa.RecordBatch.from_arrays(columns, ["phase", "stage", "zone_id", "surface_c"])


def _unpacked(file) -> Iterator[pa.RecordBatch]:
    for phase, stage, values in _surfaces(file):
        zone = np.flatnonzero(values != DRY)
        yield _wet(phase, np.full(len(zone), stage), zone, values[zone])


def _of_member(raw: bytes, first: int, meta: dict) -> Iterator[pa.RecordBatch]:
    """The wet slots of a member whose bytes are those from ``first`` on after the header."""
    stride = meta["zoneStride"]
    for phase, offset, length in _arrays(meta, stride * 2):
        lo, hi = max(first, offset), min(first + len(raw), offset + length)
        if lo < hi:
            values = np.frombuffer(raw[lo - first : hi - first], "<i2")
            wet = np.flatnonzero(values != DRY)
            slot = wet + (lo - offset) // 2
            # Slot 0 of a row is no zone.
            zoned = slot % stride > 0
            wet, slot = wet[zoned], slot[zoned]
            yield _wet(phase, slot // stride, slot % stride - 1, values[wet])


def _index(file, size: int) -> tuple[dict, list[tuple[int, int, int, int]]] | None:
    """The header, and of each later member its place and size in the file and its bytes' place and size after the header.

    None for a file whose members do not say their sizes, or whose values do not lie within one member each.
    """
    found, at, first, meta = [], 0, 0, None
    while at < size:
        file.seek(at)
        head = file.read(len(HEAD) + 8)
        if len(head) < len(HEAD) + 8 or not head.startswith(HEAD):
            return None
        n = struct.unpack("<Q", head[len(HEAD) :])[0]
        if at + n > size:
            raise ValueError("the container is cut short")
        file.seek(at + n - 4)
        length = struct.unpack("<I", file.read(4))[0]
        if meta is None:
            file.seek(0)
            with gzip.GzipFile(fileobj=io.BytesIO(file.read(n))) as z:
                meta = _header(z)
                if z.read(1):
                    return None
        else:
            found.append((at, n, first, length))
            first += length
        at += n
    if meta is None or meta.get("valueType") != "int16-le" or any(place % 2 for _, _, place, _ in found):
        return None
    arrays = _arrays(meta, meta["zoneStride"] * 2)
    if any(offset % 2 for _, offset, _ in arrays):
        return None
    if first < max((offset + length for _, offset, length in arrays), default=0):
        raise ValueError("the container is cut short")
    return meta, found


def states_of(files: DataFrame) -> DataFrame:
    """``phase, stage, zone_id, surface_c`` of the wet slots of containers (column ``content``), unpacked in the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _unpacked(io.BytesIO(content.as_py()))

    return files.select("content").mapInArrow(run, STATE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`states_of`, of the container files under ``path``; the members of a file are read side by side."""

    def opened(path: str):
        from pyarrow import fs as pafs

        # Hadoop writes a local path with one slash.
        fs, name = pafs.FileSystem.from_uri("file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path)
        return fs.open_input_file(name)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as f:
                    index = _index(f, row["length"])
                meta, found = index or ({}, [(-1, row["length"], 0, row["length"])])
                n = len(found)
                yield pa.RecordBatch.from_pydict({"path": [row["path"]] * n, "meta": [json.dumps(meta)] * n, **{c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate(("at", "n", "first", "length"))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as f:
                    if row["at"] < 0:
                        yield from _unpacked(f)
                    else:
                        f.seek(row["at"])
                        yield from _of_member(gzip.decompress(f.read(row["n"])), row["first"], json.loads(row["meta"]))

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    found = runtime.save(files.mapInArrow(places, "path string, meta string, at bigint, n bigint, first bigint, length bigint"), "container-places")
    size = found.agg(F.sum("length")).first()[0] or 0
    return found.repartition(max(1, -(-size // (2 * BLOCK_SLOTS)))).mapInArrow(run, STATE)
