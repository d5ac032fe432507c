r"""Personal data and secrets: fixed patterns, and identifiers discovered by bootstrapped contexts.

Base spans come from one pattern for each kind with its check. With keys of known
formats and hexadecimal key material they are the seeds of the bootstrap: the words
and signs around a seed are lexical patterns; a pattern is scored by how many of the
identifier-like strings it stands around are known or likely members of a kind, a
string by the patterns around it, in turns until nothing changes, over the graph of
all patterns and strings of the corpus. Strings in contexts that end with a high score
are added as spans of that kind; base spans stay. A key of a known format is a span of
kind ``secret`` wherever it stands, other key material only in such a context.

Everything is built-in functions; a span is read off by the lengths of what
lies between the matches, so offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; texts are searched whole; repeated
rows get the same spans and count once each in the graph's counts of strings, which are
of distinct strings; rows are told apart by doc_id (null is an id) and text; an empty
table gives no rows; :func:`redact` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import runtime

KINDS = ("email", "ip", "card", "phone")
#: The kind that the method adds to the base kinds, last in order.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
#: The kinds' patterns (fixed values), written so that a long run is read once: a
#: match starts where the run or the previous match's end is, and the repeated
#: groups, which are last, give nothing back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: An identifier-like string: a run with a digit or an at sign in it.
RUN = "A-Za-z0-9._%+@:/-"
CANDIDATE = rf"(?:\G|(?<![{RUN}]))[A-Za-z._%+:/-]*+[0-9@][{RUN}]*"
LEAST_CHARS = 5
#: Published formats of keys (fixed values): these are secrets wherever they stand.
KEYS = r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9_])"
#: Key material: hexadecimal digits of both sorts; seeds that become spans only in a context of high confidence.
MATERIAL = "^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}$"
#: Characters on either side in which the words and signs of a pattern must fit; a word that the window cuts is no part of one.
CONTEXT_CHARS = 60
#: Matches whose offsets are summed together: keeps the work on a text of many matches near linear.
RUN_LENGTH = 64
#: A pattern needs so many distinct members and this score to count; to add spans it needs the higher one.
LEAST_MEMBERS = 3
CARRY = 0.5
ACCEPT = 0.8
#: Added spans up to this many rows are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


NO_SPANS = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine, zero: int = 0) -> Column:
    """For each element what ``combine`` makes of all before it, in runs whose results are then carried on. ``values`` is to be a bound one."""
    none = F.array().cast("array<int>")
    runs = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(RUN_LENGTH)), lambda i: F.slice(values, i + 1, RUN_LENGTH))
    start = F.struct(F.lit(zero).alias("at"), none.alias("out"))
    own = F.transform(runs, lambda r: F.aggregate(r, start, lambda acc, x: F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))))
    begin = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    carried = F.aggregate(
        own, begin, lambda acc, x: F.struct(combine(acc["at"], x["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda v: combine(acc["at"], v).cast("int")))).alias("out")), lambda acc: acc["out"]
    )
    return F.when(F.size(values) > 0, F.flatten(carried)).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with start and end."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
        return let(gaps, lambda g: let(F.zip_with(found, g, lambda m, x: x + F.length(m)), lambda steps: struct_of(found, g, running(steps, lambda a, b: a + b))))

    def struct_of(found: Column, gaps: Column, at: Column) -> Column:
        return F.transform(F.arrays_zip(found.alias("m"), gaps.alias("gap"), at.alias("at")), lambda x: F.struct((x["at"] + x["gap"]).alias("s"), (x["at"] + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(NO_SPANS)))


def base_spans(text: Column) -> Column:
    """All kinds' spans, by start and then kind as listed: array of (s, k, e, m), k the kind's number."""
    def of(k: int, kind: str) -> Column:
        good = F.when(text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))).otherwise(F.array().cast(NO_SPANS))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _contexts(text: Column, s: Column, e: Column) -> Column:
    """Patterns of a place, signs and capitals kept: the two words before it, the word before it with the signs between, and the words on either side."""
    n = CONTEXT_CHARS
    left = F.substring(text, F.greatest(F.lit(1), s - (n - 1)), F.least(s, F.lit(n)))
    right = F.substring(text, e + 1, F.lit(n))
    # A word that the window cuts is no part of a pattern.
    left = let(left, lambda c: F.regexp_replace(F.when(s > n, F.regexp_replace(c, r"^[\p{L}\p{N}]+", "")).otherwise(c), r"\s+", " "))
    right = let(right, lambda c: F.regexp_replace(F.when(F.length(c) == n, F.regexp_replace(c, r"[\p{L}\p{N}]+$", "")).otherwise(c), r"\s+", " "))
    tail = F.regexp_extract(left, r"(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+)?[\p{L}\p{N}]+[^\p{L}\p{N}]+$", 0)
    nxt = F.regexp_extract(right, r"^[^\p{L}\p{N}]+[\p{L}\p{N}]+", 0)

    def made(tail: Column, one: Column, nxt: Column) -> Column:
        return F.array_compact(F.array(
            F.when(tail != one, F.concat(F.lit("L "), tail)),
            F.when(one.rlike(r"[^\p{L}\p{N}\s]"), F.concat(F.lit("S "), one)),
            F.when((one != "") & (nxt != ""), F.concat(F.lit("M "), one, F.lit("_"), nxt)),
        ))

    return let(tail, lambda t: let(F.regexp_extract(t, r"[\p{L}\p{N}]+[^\p{L}\p{N}]+$", 0), lambda o: let(nxt, lambda x: made(t, o, x))))


BASE = "array<struct<s:int,k:int,e:int,m:string>>"


def occurrences(docs: DataFrame, hide_percent: int = 0) -> DataFrame:
    """For every row its key, ``base`` spans, ``keys`` of known formats, and the places of seeds and candidates with their patterns.

    ``hide_percent``: so many of a hundred base strings, by their hash, are taken as candidates without a kind (``hidden``), to measure what contexts alone recover.
    """
    text = F.coalesce("text", F.lit(""))
    hinted = F.col("text").rlike("[0-9@]")
    rows = docs.select("doc_id", "text").withColumns({"text_hash": F.xxhash64("text"), "base": F.when(hinted, base_spans(text)).otherwise(F.array().cast(BASE))})
    over = lambda x, spans: F.exists(spans, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    keyed = text.contains("AKIA") | text.contains("ASIA") | text.contains("xox") | text.contains("gh")
    keys = F.transform(F.filter(matches(text, KEYS), lambda x: ~over(x, "base")), lambda x: F.struct(x["s"].alias("s"), F.lit(SECRET).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    rows = rows.withColumn("keys", F.when(keyed, keys).otherwise(F.array().cast(BASE)))
    rows = rows.withColumn("known", F.concat("base", "keys"))
    trimmed = F.transform(matches(text, CANDIDATE), lambda x: F.struct(x["s"].alias("s"), (x["e"] - F.length(x["m"]) + F.length(F.regexp_replace(x["m"], r"[^A-Za-z0-9]+$", ""))).alias("e"), F.regexp_replace(x["m"], r"[^A-Za-z0-9]+$", "").alias("m")))
    free = F.filter(trimmed, lambda x: (F.length(x["m"]) >= LEAST_CHARS) & ~over(x, "known"))
    rows = rows.withColumn("cand", F.when(hinted, free).otherwise(F.array().cast(NO_SPANS)))
    place = lambda x, k, sure: F.struct(x["s"].alias("s"), x["e"].alias("e"), k.cast("int").alias("k"), sure.alias("sure"), F.xxhash64(x["m"]).alias("inst"), _contexts(text, x["s"], x["e"]).alias("pats"))
    hidden = lambda x: (F.pmod(F.xxhash64(x["m"], F.lit(7)), F.lit(100)) < hide_percent) & (x["k"] < SECRET)
    seed = F.transform("known", lambda x: place(x, F.when(~hidden(x), x["k"]), F.lit(True)))
    new = F.transform("cand", lambda x: place(x, F.when(x["m"].rlike(MATERIAL), F.lit(SECRET)), F.lit(False)))
    bare = lambda c: F.transform(c, lambda x: x.dropFields("m"))
    return rows.select("doc_id", "text_hash", bare("base").alias("base"), bare("keys").alias("keys"), F.concat(seed, new).alias("places"))


def accepted_patterns(places: DataFrame) -> DataFrame:
    """``(pattern, k, conf)`` of high confidence, from ``places`` (k, inst, pats), one row each.

    Scores only rise from turn to turn and are rounded, so the turns end; the last one changes nothing.
    """
    edges = runtime.save(places.select(F.explode("pats").alias("pattern"), "inst", "k").groupBy("pattern", "inst").agg(F.min("k").alias("k")), "pii-edges")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    seeds = edges.where("k is not null").groupBy("inst", "k").agg(F.lit(1.0).alias("score"))
    scores, before, patterns = seeds, None, None
    while True:
        known = edges.select("pattern", "inst").join(scores, "inst")
        sums = known.groupBy("pattern", "k").agg(F.sum(F.col("score").cast("decimal(20,3)")).alias("sum"), F.count("*").alias("members"))
        rated = sums.where(F.col("members") >= LEAST_MEMBERS).join(degree, "pattern").withColumn("conf", F.round((F.col("sum") / (F.col("degree") + 1)).cast("double"), 3))
        fresh = runtime.save(rated.where(F.col("conf") >= CARRY).select("pattern", "k", "conf"), "pii-patterns")
        now = fresh.agg(F.count("*"), F.sum(F.xxhash64("pattern", "k", "conf").cast("decimal(20,0)"))).first()
        if patterns is not None:
            runtime.drop(patterns)
        patterns = fresh
        if now == before or not now[0]:
            break
        before = now
        reached = edges.select("pattern", "inst").join(patterns, "pattern").groupBy("inst", "k").agg(F.round(1 - F.exp(F.sum(F.log(1 - 0.9 * F.col("conf")))), 3).alias("score"))
        scores = runtime.save(seeds.unionByName(reached).groupBy("inst", "k").agg(F.max("score").alias("score")), "pii-scores")
    runtime.drop(edges)
    return patterns.where(F.col("conf") >= ACCEPT)


def _places(found: DataFrame) -> DataFrame:
    return found.where("size(places) > 0").select("doc_id", "text_hash", F.explode("places").alias("p")).select("doc_id", "text_hash", "p.*")


def discovered(places: DataFrame, unsure: Column) -> DataFrame:
    """``doc_id``, ``text_hash``, ``s``, ``e``, ``k`` of the unsure places in an accepted pattern, by the most confident one."""
    hits = places.where(unsure).select("doc_id", "text_hash", "s", "e", F.explode("pats").alias("pattern")).join(accepted_patterns(places), "pattern")
    return hits.groupBy("doc_id", "text_hash", "s", "e").agg(F.min(F.struct(-F.col("conf"), F.col("k")))["k"].alias("k"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``base`` and ``spans`` (all of them), arrays of (s, k, e), for every row."""
    found = runtime.save(occurrences(docs), "pii-places")
    best = discovered(_places(found), ~F.col("sure"))
    added = runtime.save(best.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "k", "e")).alias("added")), "pii-added")
    small = added.count() <= BROADCAST_ROWS
    a = (F.broadcast(added) if small else added).withColumnsRenamed({"doc_id": "a_id", "text_hash": "a_hash"})
    joined = found.join(a, found["doc_id"].eqNullSafe(F.col("a_id")) & (found["text_hash"] == F.col("a_hash")), "left")
    spans = F.sort_array(F.concat("base", "keys", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"))


def recovered(docs: DataFrame, hide_percent: int = 30) -> DataFrame:
    """By kind, of the base spans that are hidden from the bootstrap: ``n_hidden``, and ``n_found`` again as that kind by their contexts."""
    found = runtime.save(occurrences(docs, hide_percent), "pii-places")
    places = _places(found)
    truth = found.select("doc_id", "text_hash", F.explode("base").alias("b")).select("doc_id", "text_hash", "b.s", "b.e", F.col("b.k").alias("kind"))
    hidden = truth.join(places.where("sure and k is null").select("doc_id", "text_hash", "s", "e"), ["doc_id", "text_hash", "s", "e"])
    hits = discovered(places, F.col("k").isNull() & F.col("sure"))
    both = hidden.join(hits, ["doc_id", "text_hash", "s", "e"], "left")
    return both.groupBy("kind").agg(F.count("*").alias("n_hidden"), F.count_if(F.col("k") == F.col("kind")).alias("n_found"))


def described(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; other columns as they are."""
    found = find(docs).where("size(spans) > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("__spans")))).select(*docs.columns)


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans' kinds in their place; of overlapping spans the first.

    A run of spans is cut out of the text first and its pieces from that, since finding a code point reads all before it.
    """
    tags = F.array(*(F.lit(f"<{k}>") for k in NAMES))
    cut = lambda c, a, b: F.substring(c, a + 1, b - a)

    def body(clear: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(clear) - 1, F.lit(RUN_LENGTH)), lambda i: F.slice(clear, i + 1, RUN_LENGTH))
        # A run's text reaches from the end of the span before it to the end of its last one.
        parts = F.transform(runs, lambda r: F.struct(r.alias("r"), F.get(r, 0)["from"].alias("a"), cut(text, F.get(r, 0)["from"], F.element_at(r, -1)["e"]).alias("t")))
        masked = F.transform(parts, lambda p: F.array_join(F.transform(p["r"], lambda x: F.concat(cut(p["t"], x["from"] - p["a"], x["s"] - p["a"]), F.get(tags, x["k"]))), ""))
        return F.concat(F.array_join(masked, ""), F.substring(text, F.element_at(clear, -1)["e"] + 1, F.length(text)))

    reach = let(F.transform(spans, lambda x: x["e"]), lambda ends: running(ends, lambda a, b: F.greatest(a, b)))
    clear = F.filter(F.zip_with(spans, reach, lambda x, r: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), r.alias("from"))), lambda x: x["s"] >= x["from"])
    return let(clear, body)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(runtime.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(described("base"), 256).alias("base_sha256"), described("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
