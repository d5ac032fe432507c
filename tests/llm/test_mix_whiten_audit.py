"""Mixing, whitening and the audit of sources against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brineflow.llm import divergence, mixing, whitening
from brineflow.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["op11_curriculum_mix", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(llm_queries.oracle_sql()[name])
    df = llm_queries.queries()[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


# -- mixing


def filled(sizes, weights, percent=150, most=2):
    """Targets by the rule as it is told: the excess of those above their caps is shared anew until none is above."""
    budget, caps = sum(sizes) * percent / 100, [most * s for s in sizes]
    stopped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = budget - sum(caps[i] for i in stopped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > caps[i]}
        if not above:
            return [caps[i] if i in stopped else share[i] for i in range(len(sizes))]
        stopped |= above


def area(knots, t):
    at = np.linspace(0, t, 20_001)
    return np.trapezoid(np.interp(at, *zip(*knots, strict=True)), at)


def mixed_docs(spark, n=700, seed=2):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "hot", "b", "", None, "ä", "Z", "a few"])
    rows = [(i if rng.random() > 0.05 else None, "w " * rng.choice([0, 1, 3, 40, 200]) if rng.random() > 0.05 else None, "en", source(), 0) for i in range(n)]
    rows += [(5000, "long  \x85 " * 30_000, "en", "a few", 0)] + [(7, "same same", "en", "hot", 0)] * 60
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def test_mix_reaches_targets_in_order_of_position(spark):
    rows, df = mixed_docs(spark)
    mix = mixing.mix(df.withColumns({"words": F.lit("clash"), "extra": F.lit(1)}), rows_each=3)
    got = [r.asDict() for r in mix.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    # Each document once in the first pass, whatever is taken of it.
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got if r["pass"] == 0) == Counter((i, size(t), s) for i, t, _, s, _ in rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    want = dict(zip(names, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    words, texts = Counter(), defaultdict(list)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["words"] <= r["size"] and r["extra"] == 1
        assert (r["position"] is None) == (r["words"] == 0) and (r["words"] == 0) == (r["text"] is None)
        words[r["source"]] += r["words"]
        texts[r["source"]].append((r["position"], r["pass"], r["words"]))
    assert all(abs(words[s] - want[s]) <= 0.5 for s in names)
    assert sum(r["taken"] for r in got if r["pass"] == 0) == sum(words.values())
    # A document's position is where its source's schedule has given the words before it.
    for i, s in enumerate(names):
        knots, done = mixing.CURRICULUM[i % 3], 0
        for at, _, n in sorted(t for t in texts[s] if t[0] is not None):
            assert abs(area(knots, at) / area(knots, 1) - done / want[s]) < 1e-6
            done += n
    # Slices follow each other, and so do the rows within one.
    by_slice = defaultdict(list)
    for r in mix.where("words > 0").collect():
        by_slice[r["slice"]].append(r["position"])
    order = [p for k in sorted(by_slice) for p in sorted(by_slice[k])]
    assert order == sorted(order) and len(by_slice) > 4
    again = mixing.mix(df.repartition(3)).where("pass = 0").select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got if r["pass"] == 0)


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, None, None, 0), (1, " ", None, None, 0)], DOCS)).collect()
    assert [(r["words"], r["taken"], r["target"]) for r in none] == [(0, 0, 0.0)] * 2
    one = mixing.mix(spark.createDataFrame([(1, "a b c", None, "s", 0)], DOCS)).collect()
    assert sorted((r["pass"], r["words"], r["taken"]) for r in one) == [(0, 3, 5), (1, 2, 5)]
    # More asked for than the passes give.
    most = mixing.mix(spark.createDataFrame([(1, "a b c", None, "s", 0), (2, "d", None, None, 0)], DOCS), percent=900).where("pass = 0").collect()
    assert all(r["taken"] == 2 * r["size"] for r in most)


# -- whitening


def test_residues_give_exact_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (50, 3))
    moduli = whitening.primes(50 * 2**80)
    back = whitening.from_residues([whitening.residue_sums(x, p) for p in moduli], moduli)
    big = x.astype(object)
    assert (back[:3] == big.T @ big).all() and (back[3] == big.sum(0)).all()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 3).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(3, vectors[3].tolist(), "x")] * 200
    bad = [(900, None, "x"), (901, [None] + [1.0] * 11, "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] * 12, "x"), (904, [], "x"), (905, [1.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, component string").repartition(4)
    got = whitening.components(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 8 for i in range(400)} | {3: 8 * 201})
    x = np.floor(1024 * np.stack([np.asarray(v, np.float32) for _, v, _ in rows]).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    white = (y @ v[:, :8]) / np.sqrt(e[:8])
    deviation = {i: int(((n * a - s) ** 2).sum()) for (i, _, _), a in zip(rows, x, strict=True)}
    place = {i: k for k, (i, _, _) in enumerate(rows)}
    for c in range(8):
        own = [r for r in got if r["component"] == c + 1]
        mine, theirs = np.asarray([r["whitened"] for r in own]), white[[place[r["vec_id"]] for r in own], c]
        assert np.abs(mine - np.sign(mine @ theirs) * theirs).max() < 1e-8
        assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9 for r in own)


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<double>, whitened string"
    assert whitening.components(spark.createDataFrame([], schema)).count() == 0
    assert whitening.components(spark.createDataFrame([(1, [1.0, 2.0], "a")] * 3, schema)).count() == 0
    far = whitening.components(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1e300, -1e300], "b"), (None, [0.0, 0.0], None)], schema)).collect()
    assert {r["component"] for r in far} == {1} and all(r["identity_error"] < 1e-6 for r in far)
    for y, n, rest in (([[2**61, -(2**61)]], 10**9, [5, -7]), ([[3, 4]], 10**15, [10**14, 1]), ([[3, -4]], 7, [1, 2])):
        want = sum((n * a - r) ** 2 for a, r in zip(y[0], rest, strict=True))
        assert whitening.deviations(np.asarray(y), n, rest).to_pylist() == [want if want < 10**38 else None]


# -- audit of sources


def audited(rows, least, ranks):
    """Rows of the audit, by the definition."""
    docs = [(la or "", so or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", te or "")]) for _, te, la, so, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        terms = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(terms)) for t in terms}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in counts if o != s))
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pair, 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(term, 1) if k <= ranks]
    return sorted(out)


@pytest.mark.parametrize(("light", "sources", "terms"), [(6, 256, 1024), (2, 3, 7), (0, 4, 1000), (99, 5, 10)])
def test_audit_equals_brute_force_for_any_split(spark, light, sources, terms):
    rng = random.Random(7)
    words = [f"t{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["É", "é", "ße", "中文", "X\x00y"]
    text = lambda: rng.choice([" ", ".", "9", " ", "\n"]).join(rng.choice(words[: rng.choice([10, 105])]) for _ in range(rng.randint(0, 25)))
    rows = [(i, text(), rng.choice(["en", "en", "fr", None]), f"s{min(rng.randint(0, 13), rng.randint(0, 13))}", 0) for i in range(400)]
    rows += [(1, None, "en", None, 0), (2, "", "none", "a", 0), (3, "only one", "none", "b", 0), (4, "Alone " * 9, "solo", "x", 0), (5, "ta", None, "", 0)] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = divergence.audit(df, 8, 20, light, sources, terms).collect()
    assert sorted(map(tuple, got)) == audited(rows, 8, 20)


def test_audit_edges(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, None, 0), (2, "x" * 200_000 + " y" * 100_000, None, "s", 0)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).collect())) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    monkeypatch.setattr(divergence, "PIECE_BYTES", 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 4, "source": ["s"] * 4, "text": ["aa b", "", "aa", "cccccccc aa"]})
    total = Counter()
    for out in divergence._count([batch.slice(1), batch.slice(0, 1)]):
        for r in out.to_pylist():
            total[r["term"]] += r["n"]
    assert total == {"aa": 3, "b": 1, "cccccccc": 1}
    share = lambda c, n: spark.range(1).select(divergence.share(F.lit(c).cast("long"), F.lit(n).cast("long"))).first()[0]
    for c, n in ((5, 5), (10**15, 10**15 + 1), (7, 9 * 10**15)):
        assert share(c, n) == 1 + 10**9 * c // n
    assert hashlib.md5(b"1:a").hexdigest() == spark.createDataFrame([(1, "a")], "doc_id int, text string").select(mixing.digest()).first()[0]
