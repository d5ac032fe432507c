"""Raw grids as a Spark source and sink: ``spark.read.format("raw_grid")`` and ``df.write.format("raw_grid")``.

A grid is little-endian numbers of one kind, row by row: one file, or a folder of
files of a block of rows each with a ``grid.json`` that names them. Rows of a table
are ``y, x, v``. Tasks read blocks of rows, and of those only the byte ranges that
window and stride leave: whole rows are skipped, and a row is read from the first to
the last column asked for.

A task writes the blocks it has to files of its own; they become part of the grid when
the job commits, since only then does ``grid.json`` name them. An aborted job
removes what its tasks wrote. :func:`joined` makes one file of the blocks.

Options: ``path``, ``width``, ``height`` and ``dtype`` (``int16``, ``uint8``, ``int32``; a folder's own
file tells them), ``block_rows``, ``fill`` (the value of cells that are not given, and which is not
read), ``first_y``, ``last_y``, ``first_x``, ``last_x`` (both included), ``step`` and ``phase`` (cells whose
row and column leave ``phase`` by ``step``), ``header`` (JSON of further entries of ``grid.json``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "y bigint, x bigint, v int"
_ARROW = pa.schema([("y", pa.int64()), ("x", pa.int64()), ("v", pa.int32())])
DTYPES = {"int16": "<i2", "uint8": "|u1", "int32": "<i4"}
MANIFEST = "grid.json"


def _at(uri: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Rows(InputPartition):
    """Rows ``first`` to before ``stop`` of a grid, which begin at byte ``offset`` of ``file`` (None: all fill)."""

    file: str | None
    offset: int
    first: int
    stop: int


@dataclass(frozen=True)
class Shape:
    width: int
    height: int
    dtype: str
    fill: int | None

    @classmethod
    def of(cls, options: dict) -> Shape:
        if options["dtype"] not in DTYPES:
            raise ValueError(f"a grid is of {', '.join(DTYPES)}")
        fill = options.get("fill")
        return cls(int(options["width"]), int(options["height"]), options["dtype"], None if fill is None else int(fill))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(DTYPES[self.dtype]).itemsize


def selected(options: dict, shape: Shape) -> tuple[range, range]:
    """Rows and columns that window and stride leave."""
    step, phase = int(options.get("step", 1)), int(options.get("phase", 0))
    out = []
    for axis, n in (("y", shape.height), ("x", shape.width)):
        lo, hi = max(0, int(options.get(f"first_{axis}", 0))), min(n - 1, int(options.get(f"last_{axis}", n - 1)))
        out.append(range(lo + (phase - lo) % step, hi + 1, step))
    return out[0], out[1]


def cells(read_at, part: Rows, shape: Shape, rows: range, columns: range) -> Iterator[pa.RecordBatch]:
    """The cells of a block; ``read_at(offset, n)`` gives bytes of its file."""
    kind = np.dtype(DTYPES[shape.dtype])
    x = np.asarray(columns, np.int64)
    if not len(x):
        return
    skip, span = columns[0] * kind.itemsize, (columns[-1] - columns[0] + 1) * kind.itemsize
    for y in range(part.first + (rows.start - part.first) % rows.step, part.stop, rows.step):
        if y not in rows:
            continue
        raw = read_at(part.offset + (y - part.first) * shape.row_bytes + skip, span)
        if len(raw) != span:
            raise ValueError(f"{part.file} is cut short at row {y}")
        v = np.frombuffer(raw, kind)[:: columns.step].astype(np.int32)
        keep = np.ones(len(v), bool) if shape.fill is None else v != shape.fill
        yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), y, np.int64)), pa.array(x[keep]), pa.array(v[keep])], schema=_ARROW)


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, found = options["path"].rstrip("/"), {}
        fs, name = _at(self.path)
        self.is_folder = fs.get_file_info(name).type.name == "Directory"
        if self.is_folder:
            with fs.open_input_file(f"{name}/{MANIFEST}") as f:
                found = json.loads(f.read())
            self.blocks = found.pop("blocks")
        self.shape = Shape.of({k: v for k, v in found.items() if v is not None} | {k: v for k, v in options.items() if k not in found})
        self.rows, self.columns = selected(options, self.shape)
        self.block_rows = int(found.get("block_rows") or options.get("block_rows", 512))

    def partitions(self) -> list[Rows]:
        out = []
        for first in range(0, self.shape.height, self.block_rows):
            stop = min(first + self.block_rows, self.shape.height)
            wanted = self.rows[max(0, -(-(first - self.rows.start) // self.rows.step)) :] if len(self.rows) else []
            if not len(wanted) or wanted[0] >= stop:
                continue
            if not self.is_folder:
                out.append(Rows(self.path, first * self.shape.row_bytes, first, stop))
            elif str(first) in self.blocks:
                out.append(Rows(f"{self.path}/{self.blocks[str(first)]}", 0, first, stop))
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, name = _at(partition.file)
        with fs.open_input_file(name) as f:

            def read_at(offset: int, n: int) -> bytes:
                f.seek(offset)
                return f.read(n)

            yield from cells(read_at, partition, self.shape, self.rows, self.columns)


@dataclass
class Written(WriterCommitMessage):
    blocks: dict


class GridWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.shape = options["path"].rstrip("/"), Shape.of(options)
        if self.shape.fill is None:
            raise ValueError("a grid is written with a fill")
        self.block_rows, self.header = int(options.get("block_rows", 512)), json.loads(options.get("header", "{}"))
        fs, name = _at(self.path)
        if not overwrite and fs.get_file_info(f"{name}/{MANIFEST}").type.name == "File":
            raise ValueError(f"{self.path} holds a grid")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, name = _at(self.path)
        fs.create_dir(name, recursive=True)
        done: dict[str, str] = {}
        first, block = None, None

        def flush() -> None:
            if first is None:
                return
            if str(first) in done:
                raise ValueError("rows come block by block: use grids.write")
            file = f"rows-{first:09d}-{uuid.uuid4().hex[:12]}.raw"
            with fs.open_output_stream(f"{name}/{file}") as out:
                out.write(block.tobytes())
            done[str(first)] = file

        for batch in iterator:
            y, x, v = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
            if len(y) and (y.min() < 0 or y.max() >= self.shape.height or x.min() < 0 or x.max() >= self.shape.width):
                raise ValueError("a cell lies beyond the grid")
            of = y // self.block_rows * self.block_rows
            cuts = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(np.arange(len(y)), cuts):
                if not len(part):
                    continue
                if of[part[0]] != first:
                    flush()
                    first = int(of[part[0]])
                    block = np.full((min(self.block_rows, self.shape.height - first), self.shape.width), self.shape.fill, DTYPES[self.shape.dtype])
                block[y[part] - first, x[part]] = v[part]
        flush()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        fs, name = _at(self.path)
        blocks = {k: f for m in messages if m is not None for k, f in m.blocks.items()}
        head = self.header | {"width": self.shape.width, "height": self.shape.height, "dtype": self.shape.dtype, "fill": self.shape.fill, "block_rows": self.block_rows}
        fs.create_dir(name, recursive=True)
        aside = f"{name}/.{MANIFEST}.{uuid.uuid4().hex[:8]}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps(head | {"blocks": dict(sorted(blocks.items(), key=lambda kv: int(kv[0])))}).encode())
        fs.move(aside, f"{name}/{MANIFEST}")
        self._remove(lambda f: f not in blocks.values())

    def abort(self, messages: list[Written]) -> None:
        """What the grid's file does not name goes: nothing is left of a job that never committed."""
        fs, name = _at(self.path)
        kept: set = set()
        if fs.get_file_info(f"{name}/{MANIFEST}").type.name == "File":
            with fs.open_input_file(f"{name}/{MANIFEST}") as f:
                kept = set(json.loads(f.read())["blocks"].values())
        self._remove(lambda f: f not in kept)

    def _remove(self, gone) -> None:
        from pyarrow import fs as pafs

        fs, name = _at(self.path)
        for info in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
            if info.base_name.startswith("rows-") and gone(info.base_name):
                fs.delete_file(info.path)


class RawGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(RawGrid)
    return spark.read.format("raw_grid").options(path=path, **options).load()


def write(df: DataFrame, path: str, width: int, height: int, dtype: str = "int16", fill: int = -32768, block_rows: int = 512, **options: str | int) -> None:
    """Write cells (y, x, v): each block of rows is dealt to one task, so tasks hold one block each."""
    df.sparkSession.dataSource.register(RawGrid)
    rows = df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("int").alias("v")).where("v is not null")
    dealt = rows.repartition(F.floor(F.col("y") / block_rows)).sortWithinPartitions("y")
    dealt.write.format("raw_grid").options(path=path, width=width, height=height, dtype=dtype, fill=fill, block_rows=block_rows, **options).mode("overwrite").save()


def joined(spark: SparkSession, path: str, out: str) -> None:
    """One file of a folder's blocks, in order; one task copies them, a block at a time."""
    spark.dataSource.register(RawGrid)

    def copy(_) -> Iterator[pa.RecordBatch]:
        grid = GridReader({"path": path})
        fs, name = _at(path)
        to, target = _at(out)
        aside = f"{target}.{uuid.uuid4().hex[:8]}"
        with to.open_output_stream(aside) as f:
            for first in range(0, grid.shape.height, grid.block_rows):
                if file := grid.blocks.get(str(first)):
                    with fs.open_input_file(f"{name}/{file}") as block:
                        f.write(block.read())
                else:
                    rows = min(grid.block_rows, grid.shape.height - first)
                    f.write(np.full(rows * grid.shape.width, grid.shape.fill, DTYPES[grid.shape.dtype]).tobytes())
        to.move(aside, target)
        yield pa.RecordBatch.from_arrays([pa.array([grid.shape.height])], ["rows"])

    spark.range(1).repartition(1).mapInArrow(copy, "rows bigint").collect()
