"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Sets of similar size share a scheme: the universe of shingles is hashed into
one segment more than two linked sets of that size can differ in shingles, so
two linked sets agree in one segment at least. A set is indexed under each
segment's content (a sum of its shingles' hashes) and, for the spare segments of
each scheme, under their contents less one shingle. A set does not probe its
smallest segments, and those of common shingles, which match by chance, and allows
as many other spare segments a difference of one instead: the pigeonhole count is the
same. An empty spare is given up like any other segment, so next to no set probes what
a constant share of all sets have in common.
A scheme has so many spares that next to no set has more empty segments.
Sets of one band are also indexed in the scheme of the next, since linked sets
lie in neighbouring bands.

Equal sets are merged first. Sets that meet under a signature are not paired
with each other but with one hub; what the verified links then leave in
different components under one signature is paired within it, behind a lower
bound on the difference from parity sketches. Every pair is verified on the
words themselves. So no link between components is lost and no group is paired
out in full.

Defined results: null and empty texts have no shingles and no links; a text of
fewer words than a shingle is one shingle; rows that share a doc_id are taken
as one document with several texts; a null doc_id is linked with nothing;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.llm.mph import MUL, mix
from brineflow.operators.graph import connected_components

#: A-Z to a-z, other bytes as they are.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Nodes up to this many (16 bytes each) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Longs of a parity sketch, and of the same folded, for the rows of signatures.
SKETCH, FOLDED = 32, 8
#: Sets of more shingles have a second sketch of as many bits as shingles: that of fixed size tells nothing of long texts.
WIDE_FROM = 64 * SKETCH // 2
#: A shingle of one set is in another unrelated set of the band with this weight, for the allocation.
CHANCE = 0.25
#: Shingles in this share of the documents or more are common: their segments match more than by chance. One document in
#: COMMON_SAMPLE is counted for that; there are no more of them than shingles in a document, on average, over the share.
COMMON, COMMON_SAMPLE, COMMON_WEIGHT = 0.002, 32, 50.0
#: What probing deletions costs besides chance matches.
PROBE = 0.03


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], k: int) -> set:
    """The exact shingle set."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(k, n)
    h = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        h = (h ^ w[i : n - span + 1 + i]) * np.uint64(MUL)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def most_apart(total: int, percent: int) -> int:
    """Shingles in which two linked sets of ``total`` shingles together differ at most."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def band_ends(percent: int, top: int) -> tuple[int, ...]:
    """The largest size of each band; linked sets lie in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, 100 * ends[-1] // percent))
    return tuple(ends)


def band_of(n: int, percent: int) -> int:
    top = 1 << 12
    while top < n:
        top <<= 2
    return int(np.searchsorted(np.asarray(band_ends(percent, top)), n))


def scheme(band: int, percent: int) -> int:
    """Segments of a band's scheme."""
    top = 1 << 12
    while len(ends := band_ends(percent, top)) <= band:
        top <<= 2
    return most_apart(2 * ends[band], percent) + 1


@lru_cache(maxsize=4096)
def spares(band: int, percent: int) -> int:
    """Segments of a band's scheme that are indexed with deletions: as many as segments that are empty in nearly every set of the band at most."""
    m = scheme(band, percent)
    top = 1 << 12
    while len(ends := band_ends(percent, top)) <= band:
        top <<= 2
    empty = m * float(np.exp(-0.9 * ends[band] / m))
    return min(m // 2, max(1, int(np.ceil(empty + 4 * empty**0.5 + 1)) if empty > 0.05 else 1)) if m > 1 else 0


Common = tuple[np.ndarray, np.ndarray]
NONE_COMMON: Common = (np.zeros(0, np.uint64), np.zeros(0))


def common_shingles(docs: DataFrame, k: int) -> Common:
    """Hashes of the common shingles, sorted, and their shares. The choice of segments depends on them, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(words_of(text), k).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_SAMPLE)) == 0).select("text")
    least = max(5.0, COMMON * some.count())
    rows = some.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") >= least).toPandas().sort_values("h")
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["count"].to_numpy(np.float64)[order] * COMMON / least


def signatures(u: np.ndarray, band: int, percent: int, probing: bool, common: Common = NONE_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Signatures in a band's scheme: those that probe and those that are only found.

    A segment's chance to match is by its size, or, where all its shingles are common, by the share of the rarest.
    """
    m, k = scheme(band, percent), spares(band, percent)
    seg = (mix(u, 2 * band + 101) % np.uint64(m)).astype(np.int64)
    value = mix(u, 7)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, value)
    name = mix((np.uint64(band) << np.uint64(32)) + np.arange(m, dtype=np.uint64), 3)
    whole = mix(total ^ name, 5)
    inside = seg >= m - k
    owner = seg[inside]
    less = mix((total[owner] - value[inside]) ^ name[owner], 5)
    if not probing:
        return whole[:0], np.concatenate([whole, less])
    size = np.bincount(seg, minlength=m)
    chance = CHANCE ** size.astype(np.float64)
    if len(common[0]) and len(u):
        at = np.minimum(np.searchsorted(common[0], u), len(common[0]) - 1)
        rarest = np.ones(m)
        np.minimum.at(rarest, seg, np.where(common[0][at] == u, common[1][at], 0.0))
        chance = np.maximum(chance, np.minimum(1.0, COMMON_WEIGHT * rarest) * (size > 0))
    spare = size[m - k :]
    # Segments that match most by chance, spares among them, against the other spares whose deletions cost least, in pairs,
    # as long as that is cheaper.
    order = np.argsort(-chance, kind="stable")[: 2 * k]
    cost = np.full(m, np.inf)
    cost[m - k :] = np.where(spare > 0, (1 + spare) * np.maximum(CHANCE ** (spare - 1.0), chance[m - k :]) + PROBE, np.inf)
    probes, boosted = np.ones(m, bool), np.zeros(m, bool)
    cheap = iter(m - k + np.argsort(cost[m - k :], kind="stable"))
    for give in order:
        if boosted[give]:
            continue
        take = next((t for t in cheap if probes[t] and t != give), None)
        if take is None or chance[give] <= cost[take]:
            break
        probes[give], boosted[take] = False, True
    return np.concatenate([whole[probes], less[boosted[owner]]]), np.concatenate([whole[~probes], less[~boosted[owner]]])


def parity_sketch(u: np.ndarray) -> np.ndarray:
    """Bits that tell an odd number of shingles; two sets differ in as many shingles as bits at least."""
    bit = mix(u, 11) % np.uint64(64 * SKETCH)
    odd = (np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view("<i8")


def wide_sketch(u: np.ndarray) -> np.ndarray:
    """A parity sketch of a large set, of the next power of two of bits; empty for other sets.

    The sketch of fewer bits is the exclusive or of a longer one's parts.
    """
    if len(u) <= WIDE_FROM:
        return np.zeros(0, np.int64)
    bits = 1 << (len(u) - 1).bit_length()
    odd = (np.bincount((mix(u, 13) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view("<i8")


SETS = "doc_id bigint, n int, h1 bigint, h2 bigint, sketch array<bigint>, wide array<bigint>, probe array<bigint>, found array<bigint>"


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))  # some 16 bytes for each common shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
        names = ["doc_id", "n", "h1", "h2", "sketch", "wide", "probe", "found"]

        def lists(parts: list[np.ndarray]) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n, h1, h2, sketch, wide, probe, found = [], [], [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    u = shingle_hashes(words_of(text), k)
                    n.append(len(u))
                    sums = [int(mix(u, s).sum(dtype=np.uint64)) if len(u) else 0 for s in (17, 19)]
                    h1.append(np.uint64(sums[0]).view(np.int64))
                    h2.append(np.uint64(sums[1]).view(np.int64))
                    wide.append(wide_sketch(u))
                    if len(u):
                        b = band_of(len(u), percent)
                        own, other = signatures(u, b, percent, True, shared.value)
                        lifted = signatures(u, b + 1, percent, False)[1]
                        sketch.append(parity_sketch(u))
                        probe.append(own)
                        found.append(np.concatenate([other, lifted]))
                    else:
                        sketch.append(np.zeros(SKETCH, np.int64))
                        probe.append(u)
                        found.append(u)
                arrays = [batch.column(0), pa.array(n, types[1]), pa.array(np.asarray(h1, np.int64)), pa.array(np.asarray(h2, np.int64)), lists(sketch), lists(wide), lists(probe), lists(found)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SETS)


#: One set in so many is counted to find the signatures that many share; those with more than HOT_SETS of them are split in SALTS parts.
SAMPLE, HOT_SETS, SALTS = 64, 16, 64
NONE = np.iinfo(np.int64).min
STARS = "sig bigint, hub bigint, node bigint, probes boolean, salt int, open boolean"


def hot_signatures(rows: DataFrame) -> DataFrame:
    """Signatures that very many sets share: how the work is laid out, not what is found, depends on them.

    As many as BROADCAST_NODES at most, since each stands for so many of the rows that are counted.
    """
    counted = runtime.save(rows.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("sig").count().where(F.col("count") > HOT_SETS), "hot-signatures")
    total = counted.agg(F.sum("count")).first()[0] or 0
    return counted.where(F.col("count") > total // BROADCAST_NODES).select("sig")


def stars(rows: DataFrame) -> DataFrame:
    """Under each signature that a set probes and another shares, each other set with one hub: the smallest that probes.

    ``rows``: (sig, node, probes). The sets of a hot signature are dealt into parts; each part has a hub of its own, and
    the hubs, with the sets of parts where none probes, form a star in turn. ``salt`` is over 0 for rows of such parts.
    """
    hot = hot_signatures(rows)
    if hot.isEmpty():
        parted = rows.withColumn("salt", F.lit(0))
    else:
        part = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
        parted = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left").select("sig", "node", "probes", part.alias("salt"))
    made = runtime.save(_stars(parted), "stars")
    first = made.where("not open").drop("open")
    if hot.isEmpty():
        return first
    again = _stars(made.where("open").select("sig", "node", "probes", F.lit(0).alias("salt"))).where("not open").withColumn("salt", F.lit(SALTS + 1))
    return first.unionByName(runtime.save(again.drop("open"), "stars"))


def _stars(rows: DataFrame) -> DataFrame:
    """One star for each signature and salt, streamed in order, so that the length of a run does not matter.

    Rows with a salt also give, as ``open`` rows, the hub of their part or, where none probes, themselves.
    """
    ordered = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", F.desc("probes"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0, salt0, hub0 = None, None, NONE  # of the run that the last batch ended in; NONE: no set in it probes
        for batch in batches:
            sig, node, salt = (batch.column(k).to_numpy() for k in (0, 1, 3))
            probes = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            if not len(sig):
                continue
            new = np.concatenate([[sig0 is None or sig[0] != sig0 or salt[0] != salt0], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])])
            head = np.flatnonzero(new)
            # The run that is carried on comes first.
            hubs = np.concatenate([[hub0], np.where(probes[head], node[head], NONE)])
            hub = hubs[np.cumsum(new)]
            is_head = new & probes
            open_ = (salt > 0) & (is_head | (hub == NONE))
            keep = ((hub != NONE) & (node != hub)) | open_
            if keep.any():
                columns = [sig, np.where(open_, node, hub), node, probes, salt, open_]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["sig", "hub", "node", "probes", "salt", "open"])
            sig0, salt0, hub0 = sig[-1], salt[-1], int(hub[-1])

    return ordered.mapInArrow(run, STARS)


def _apart(a: str, b: str, longs: int) -> str:
    """Bits in which two sketches differ: a lower bound on the shingles in which the sets do."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(longs))


def _wide_apart(a: str, b: str) -> str:
    """As :func:`_apart` for sketches whose lengths, powers of two, may differ: the longer is folded to the shorter."""
    least = f"least(size({a}), size({b}))"
    fold = lambda c: f"aggregate(sequence(0, size({c}) div {least} - 1), 0L, (x, j) -> x ^ get({c}, i + j * {least}))"
    return f"aggregate(sequence(0, {least} - 1), 0, (s, i) -> s + bit_count({fold(a)} ^ {fold(b)}))"


def _alike(a: str, b: str, percent: int) -> str:
    """Whether two sets' sizes let them be linked."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and sketches let be linked, with ``apart``: before any text is fetched."""
    facts = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.select("a", "b").distinct().join(facts("a"), "a").join(facts("b"), "b").where(_alike("n_a", "n_b", percent))
    both = both.withColumn("apart", F.expr(_apart("s_a", "s_b", SKETCH)))
    most = f"((n_a + n_b) * {100 - percent}) div {100 + percent}"
    near = both.where(f"apart <= {most}").select("a", "b", "n_a", "n_b", "apart")
    # Large sets show what is left of them in their own sketches, which only these pairs fetch.
    wide = lambda c: reps.where("size(wide) > 0").select(F.col("rep").alias(c), F.col("wide").alias(f"w_{c}"))
    near = near.join(wide("a"), "a", "left").join(wide("b"), "b", "left")
    return near.where(f"w_a is null or w_b is null or {_wide_apart('w_a', 'w_b')} <= {most}").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sets are as similar as ``percent`` asks, on the words themselves; written."""
    pairs = runtime.save(pairs.select("a", "b").distinct(), "pairs")
    nodes = runtime.save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
    small = nodes.count() <= BROADCAST_NODES
    texts = runtime.save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(nodes) if small else nodes, "doc_id", "left_semi"), "texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def of(text: str | None) -> set:
            return shingles(words_of(text), k)

        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = of(ta), of(tb)
                small, large = sorted((len(a), len(b)))
                if not small or 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    links = runtime.save(two.mapInArrow(run, "a bigint, b bigint"), "links")
    for done in (pairs, nodes, texts):
        runtime.drop(done)
    return links


def _labelled(rows: DataFrame, node: str, components: DataFrame, out: str) -> DataFrame:
    """Add a node's component, itself where it has no link."""
    names = components.select(F.col("node").alias(node), F.col("component").alias("__c"))
    return rows.join(names, node, "left").withColumn(out, F.coalesce("__c", node)).drop("__c")


def meeting(full: DataFrame) -> DataFrame:
    """The pairs x, y of a signature of different components, x outside its largest, of which one probes it.

    Sets that are only found meet those that probe and no others, so a signature that very many sets share by chance costs
    as many pairs as it has sets for each of the few that probe it.
    """
    side = lambda rows, i: rows.select("sig", F.col("node").alias(i), *[F.col(c).alias(f"{name}{i}") for c, name in (("c", "c"), ("n", "n"), ("folded", "f"), ("sketch", "s"), ("wide", "w"))])
    outside = full.where("c <> big")
    joined = side(outside.where("probes"), "x").join(side(full, "y"), "sig").where("cx <> cy")
    return joined.unionByName(side(outside.where("not probes"), "x").join(side(full.where("probes"), "y"), "sig").where("cx <> cy"))


def left_over(star: DataFrame, reps: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, apart) that share a signature one of them probes, lie in different components and may be linked.

    Under each signature the sets outside its largest component meet all others
    that probe it, or, if they probe it themselves, all others; what meets is
    bounded from below in its difference, and only pairs within the bound come
    out.
    """
    # Hubs of parts have met their own part only.
    hubs = star.where("salt > 0").select("sig", F.col("hub").alias("node"), F.lit(True).alias("probes")).distinct()
    named = _labelled(star.select("sig", "node", "probes").unionByName(hubs), "node", components, "c")
    open_ = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("probes").alias("any")).where("lo <> hi and any").select("sig")
    rows = runtime.save(named.join(open_, "sig", "left_semi"), "open-signatures")
    sizes = rows.groupBy("sig", "c").count()
    largest = sizes.groupBy("sig").agg(F.max_by("c", F.struct("count", "c")).alias("big"))
    folded = F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), lambda i: reduce(lambda a, b: a.bitwiseXOR(b), [F.get("sketch", i + k) for k in range(0, SKETCH, FOLDED)]))
    # Few bits tell most pairs apart, all bits those of sets of up to some thousands of shingles, their own sketches the few larger ones.
    facts = reps.select(F.col("rep").alias("node"), "n", folded.alias("folded"), "sketch", F.expr(f"if(size(wide) > {2 * SKETCH}, wide, null)").alias("wide"))
    full = runtime.save(rows.join(facts, "node").join(largest, "sig"), "open-sets")
    most = f"((nx + ny) * {100 - percent}) div {100 + percent}"
    within = f"({_apart('fx', 'fy', FOLDED)}) <= {most} and ({_apart('sx', 'sy', SKETCH)}) <= {most} and (wx is null or wy is null or {_wide_apart('wx', 'wy')} <= {most})"
    joined = meeting(full).where(f"{_alike('nx', 'ny', percent)} and {within}")
    pairs = possible(joined.select(F.col("x").alias("a"), F.col("y").alias("b")), reps, percent)
    return runtime.save(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "apart"), "left-over")


def _by_set(rows: DataFrame, sets: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """Rows with their set's columns, one row of ``sets`` (key, ``copies`` and others) for each key.

    The sets of many rows are broadcast: no more than BROADCAST_NODES have more than their share of the rows.
    """
    many = F.col("copies") > max(256, n_rows // BROADCAST_NODES)
    hot = F.broadcast(sets.where(many).drop("copies"))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(sets.where(many).select(*key)), key, "left_anti").join(sets.where(~many).drop("copies"), key))


def components_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; equal rows give equal rows."""
    sets = runtime.save(shingle_sets(docs, k, percent), "sets")
    key = ["n", "h1", "h2"]
    facts = runtime.save(sets.select("doc_id", *key, "sketch", "wide"), "facts")
    whole = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    n_rows = facts.count()
    reps = runtime.save(facts.where(whole).groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("sketch", "wide"), "doc_id").alias("s")).select(*key, "rep", "copies", "s.*"), "distinct-sets")
    again = reps.where("copies > 1").select(*key, "rep", "copies")
    copies = _by_set(facts.where(whole).select("doc_id", *key), again, key, n_rows).where("doc_id <> rep").select("doc_id", *key).distinct()
    copies = runtime.save(copies, "copies")
    # Only one set of equal ones goes on; its signatures stay where they are if the copies' names are few.
    few = copies.count() <= BROADCAST_NODES
    own = sets.where(whole).join(F.broadcast(copies) if few else copies, ["doc_id", *key], "left_anti")
    rows = own.select(F.explode("probe").alias("sig"), F.col("doc_id").alias("node"), F.lit(True).alias("probes")).unionByName(own.select(F.explode("found").alias("sig"), F.col("doc_id").alias("node"), F.lit(False).alias("probes")))
    star = stars(rows)
    runtime.drop(sets)
    hubs = star.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    links = verify(possible(hubs, reps, percent), docs, k, percent)
    components = runtime.save(connected_components(links), "components")
    todo, nth = left_over(star, reps, components, percent), 0
    runtime.drop(star)
    while not todo.isEmpty():
        # The nearest few of each set and other component first: most of the rest then lies in one component.
        rank = F.row_number().over(Window.partitionBy("x", "cy").orderBy("apart", "y"))
        ranked = runtime.save(todo.transform(_labelled, "x", components, "cx").transform(_labelled, "y", components, "cy").where("cx <> cy").withColumn("rank", rank), "ranked")
        now = ranked.where(F.col("rank") <= 4**nth)
        more = verify(now.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), docs, k, percent)
        links = runtime.save(links.unionByName(more), "links")
        components = runtime.save(connected_components(links), "components")
        rest = ranked.where(F.col("rank") > 4**nth).select("x", "y", "apart")
        todo = runtime.save(rest.transform(_labelled, "x", components, "cx").transform(_labelled, "y", components, "cy").where("cx <> cy").select("x", "y", "apart"), "left-over")
        nth += 1
    of_set = runtime.save(_labelled(reps.select(*key, "rep", "copies"), "rep", components, "component_id").drop("rep"), "set-components")
    linked = _by_set(facts.where(whole).select("doc_id", *key), of_set, key, n_rows).select("doc_id", "n", "component_id")
    alone = facts.where(~whole).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one, that with the smallest id, of each group of linked documents.

    Rows that repeat id and text become one; rows that share an id but whose texts are not linked all stay; a null id
    is linked with nothing and stays. The rows that stay do not depend on partitioning.
    """
    text_hash = F.xxhash64("text")
    narrow = docs.where("doc_id is not null").select("doc_id", text_hash.alias("h"))
    again = narrow.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1")
    again = runtime.save(again.select("doc_id", (F.col("lo") != F.col("hi")).alias("unlike")), "repeated-ids")
    if again.where("unlike").isEmpty():
        found = components_of(docs.select("doc_id", "text"), k, percent)
        gone = found.where("component_id <> doc_id").select("doc_id").distinct()
        kept = docs.join(gone, "doc_id", "left_anti")
    else:
        # Each different text of an id is a node of its own, numbered in the order of ids.
        order = ["doc_id", "h"]
        nodes = runtime.save(narrow.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "text-nodes")
        named = docs.select("doc_id", "text", text_hash.alias("h")).join(nodes, order)
        found = components_of(named.select(F.col("node").alias("doc_id"), "text"), k, percent)
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("node")).distinct().join(nodes, "node").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_hash"))
        kept = docs.join(gone, (F.col("doc_id") == F.col("g_id")) & (text_hash == F.col("g_hash")), "left_anti")
    if again.isEmpty():
        return kept
    row = F.struct(*kept.columns)
    once = kept.join(again.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", text_hash.alias("__h")).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return kept.join(again.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    return components_of(docs, k=3, percent=90)
