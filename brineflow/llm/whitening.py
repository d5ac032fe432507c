"""Whitening of embeddings by an exact scatter matrix.

Every entry c becomes the whole number x = floor(1024 c) + 100000. Each task
multiplies its vectors modulo several primes, so small that a block's products
sum exactly in doubles; the residues are added up by Spark, and Chinese
remaindering gives the sums and the scatter matrix as whole numbers, however
many vectors there are. What is rounded is one division for each entry of the
covariance; ``eigh`` in doubles follows.

Defined results: rows whose vector is null, empty, or holds a null or an entry
that is not finite go, and so do those of another length than most vectors
have (the longer on a tie); entries beyond 2**51 count as 2**51; repeated rows
count and stay; components without variance (a table of one vector, more
dimensions than vectors) are left out; an empty table gives no rows. Other
columns are carried along; the columns added replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brineflow import runtime

SCALE, SHIFT = 1024, 100_000
#: Entries are cut here, so that differences of whole numbers fit in 64 bits.
MOST = float(2**51)
COMPONENTS = 8
#: Primes are below this; half of its square times BLOCK_ROWS is exact in a double.
PRIME_BELOW = 1 << 21
BLOCK_ROWS = 4096
#: Numbers that one row of residues holds at most, and rows of residues that one sum gathers at first.
CHUNK, FAN = 1 << 16, 256
#: Entries of vectors that a task holds at once.
HELD = 1 << 21


def primes(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product is above twice ``bound``."""
    out, product, p = [], 1, PRIME_BELOW - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(entries.astype(np.float64), -MOST, MOST)).astype(np.int64) + SHIFT


def residue_sums(x: np.ndarray, p: int) -> np.ndarray:
    """Scatter rows and, last, the sums of the columns of ``x``, modulo ``p``."""
    d = x.shape[1]
    out = np.zeros((d + 1, d), np.int64)
    for at in range(0, len(x), BLOCK_ROWS):
        r = x[at : at + BLOCK_ROWS] % p
        r = (r - np.where(2 * r > p, p, 0)).astype(np.float64)
        out[:d] += np.rint(r.T @ r).astype(np.int64) % p
        out[d] += r.sum(0).astype(np.int64) % p
    return out % p


def from_residues(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers next to zero that have these residues."""
    product = prod(moduli)
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(2 * total > product, total - product, total)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, HELD // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            entries = part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
            yield part, whole(entries.reshape(-1, d))


@dataclass(frozen=True)
class Whitening:
    """What was fitted: bounded by the square of the vectors' length."""

    d: int
    n: int
    #: Sums of the whole numbers by dimension, and their covariance, rounded once.
    sums: list[int]
    covariance: np.ndarray
    #: By falling variance: components as rows, their variance and its share of the whole.
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def exact_sums(rows: DataFrame, vector: str, d: int, bound: int) -> tuple[list[int], np.ndarray]:
    """Sums of the dimensions and scatter matrix, exactly; ``bound`` is on the absolute value of any of them."""
    moduli = primes(bound)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((d + 1, d), np.int64) for _ in moduli]
        for _, x in _blocks(batches, vector, d):
            for s, p in zip(sums, moduli, strict=True):
                s += residue_sums(x, p)
        task = TaskContext.get().partitionId() % FAN
        for k, (s, p) in enumerate(zip(sums, moduli, strict=True)):
            flat = (s % p).ravel()
            chunks = [flat[a : a + CHUNK] for a in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(chunks), pa.int32()), pa.array(range(len(chunks)), pa.int32()), pa.array([task] * len(chunks), pa.int32()), pa.array(chunks, pa.list_(pa.int64()))], ["prime", "chunk", "part", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        lists = table.column("sums").combine_chunks()
        total = lists.flatten().to_numpy().reshape(len(lists), -1).sum(0) % moduli[key[0].as_py()]
        return pa.table({"prime": [key[0].as_py()], "chunk": [key[1].as_py()], "part": [0], "sums": [total]}, schema)

    schema = pa.schema([("prime", pa.int32()), ("chunk", pa.int32()), ("part", pa.int32()), ("sums", pa.list_(pa.int64()))])
    ddl = "prime int, chunk int, part int, sums array<bigint>"
    parts = rows.select(vector).mapInArrow(part, ddl)
    few = parts.groupBy("prime", "chunk", "part").applyInArrow(added, ddl).groupBy("prime", "chunk").applyInArrow(added, ddl)
    # One row for each prime and chunk of the matrix.
    got = {(r["prime"], r["chunk"]): r["sums"] for r in few.collect()}
    n_chunks = -(-(d + 1) * d // CHUNK)
    residues = [np.concatenate([np.asarray(got[k, c], np.int64) for c in range(n_chunks)]).reshape(d + 1, d) for k in range(len(moduli))]
    exact = from_residues(residues, moduli)
    return exact[d].tolist(), exact[:d]


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable vectors; None where there are none."""
    rows = df.where(usable(vector))
    top = F.max(F.array_max(F.transform(vector, F.abs))).cast("double")
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"), top.alias("top")).collect()
    if not sizes:
        return None
    d, n, top = max(sizes, key=lambda r: (r["n"], r["d"]))
    largest = int(SCALE * min(top, MOST)) + 1 + SHIFT
    sums, scatter = exact_sums(rows.where(F.size(vector) == d), vector, d, n * largest**2)
    s = np.asarray(sums, object)
    covariance = ((n * scatter - np.outer(s, s)) / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    keep = [k for k in range(min(most, d)) if values[k] > d * np.finfo(float).eps * values[0] and values[k] > 0]
    vectors = vectors[keep]
    if keep:  # the sign is that of the largest entry
        vectors = vectors * np.sign(vectors[np.arange(len(keep)), np.abs(vectors).argmax(1)])[:, None]
    trace = float(np.trace(covariance))
    return Whitening(d, n, sums, covariance, vectors, values[keep], values[keep] / trace if keep else values[keep])


def deviations(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """The sums over dimensions of (n y - rest)**2, exactly; null where they have more than 38 digits."""
    d, top, far = y.shape[1], int(np.abs(y).max(initial=0)), max(map(abs, rest), default=0)
    if d * (n * top + far) ** 2 < 2**63:
        z = n * y - np.asarray(rest, np.int64)
        return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
    if d * top * max(top, far) < 2**63:  # the two sums of products fit, what is made of them may not
        squares, crossed = (y * y).sum(1).astype(object), (y @ np.asarray(rest, np.int64)).astype(object)
        exact = n * n * squares - 2 * n * crossed + sum(r * r for r in rest)
    else:
        z = n * y.astype(object) - np.asarray(rest, object)
        exact = (z * z).sum(1)
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact.tolist()], pa.decimal128(38, 0))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``deviation`` (decimal) and ``whitened``, an array with an entry for each component."""
    df = df.drop(*({"deviation", "whitened"} - {vector})).where(usable(vector) & (F.size(vector) == model.d))
    n, d = model.n, model.d
    near = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [s - n * m for s, m in zip(model.sums, near, strict=True)]
    scaled = (model.components / np.sqrt(model.variance)[:, None]).T
    schema = T.StructType([*df.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    offset = np.asarray([r / n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, vector, d):
            y = x - np.asarray(near, np.int64)
            made = (y - offset) @ scaled
            bounds = pa.array(np.arange(len(y) + 1, dtype=np.int32) * made.shape[1])
            white = pa.ListArray.from_arrays(bounds, pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, deviations(y, n, rest), white], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance, centred as it is gathered, less the identity."""
    at = lambda i: F.get("whitened", F.lit(i))
    pairs = [F.abs(F.covar_pop(at(i), at(j)) - float(i == j)) for i in range(k) for j in range(i, k)]
    return white.agg(F.greatest(*pairs, F.lit(0.0))).first()[0]


def components(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: the row's other columns, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    df = df.drop(*(c for c in added if c != vector))
    model = fit(df, vector, most)
    if model is None or not len(model.variance):
        nothing = {"component": "int", "n": "bigint", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return df.drop(vector).limit(0).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    white = runtime.save(whiten(df, model, vector).drop(vector if vector != "whitened" else ""), "whitened")
    error = identity_error(white, len(model.variance))
    shares = F.array(*(F.lit(float(e)) for e in model.explained))
    rows = white.select(*(c for c in white.columns if c != "whitened"), F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        *(c for c in white.columns if c not in added),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(runtime.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
