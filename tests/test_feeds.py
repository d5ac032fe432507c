"""The gauge feed as a source and a stream, and levels at anchors from a stream."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from brineflow.sources import feeds
from brineflow.streaming import gauges, interpolation


def body(values):
    return json.dumps({"value": {"timeSeries": [{"values": [{"value": [{"value": str(v), "dateTime": t} for t, v in values]}]}]}})


def record(base, station, day, values):
    folder = base / f"station={station}" / f"day={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part-0.txt").write_text(body(values))


def days(first, n):
    return [date.fromisoformat(first) + timedelta(days=k) for k in range(n)]


def hours(day, level, step=6):
    return [(f"{day}T{h:02d}:00:00Z", level + h / 100) for h in range(0, 24, step)]


@pytest.fixture
def recorded(tmp_path):
    base = tmp_path / "feed"
    for k, day in enumerate(days("2024-01-01", 30)):
        for s in ("a", "b"):
            record(base, s, day, hours(day, k))
    return base


def options(base, **more):
    return {"base": f"file://{base}", "stations": "a,b", "start": "2024-01-01", "end": "2024-01-30", "chunk_days": 10} | more


def test_filters_drop_requests_before_any_is_made(spark, recorded):
    whole = feeds.feed(spark, **options(recorded, prune="true"))
    assert whole.rdd.getNumPartitions() == 6 and whole.count() == 240
    # What a filter leaves out is never asked for: it would not parse.
    for s, day in (("a", "2024-01-12"), ("b", "2024-01-25"), ("b", "2024-01-02")):
        (recorded / f"station={s}" / f"day={day}" / "part-0.txt").write_text("{")
    late = whole.where("station = 'a' and day >= date'2024-01-22'")
    assert late.rdd.getNumPartitions() == 1 and late.count() == 36
    early = whole.where((F.col("t") < feeds._second(date(2024, 1, 9))) & F.col("station").isin("a", "c"))
    assert early.rdd.getNumPartitions() == 1 and early.count() == 32
    assert whole.where("day > date'2024-01-30' and station = 'a'").count() == 0
    with pytest.raises(Exception, match="JSON|Expecting"):
        whole.count()
    asked = feeds.feed(spark, **options(recorded, first_day="2024-01-13", last_day="2024-01-14", stations="a"))
    assert asked.rdd.getNumPartitions() == 1
    (recorded / "station=a" / "day=2024-01-12" / "part-0.txt").write_text(body([]))
    assert asked.count() == 8


def test_one_frame_may_be_scanned_twice_in_a_query(spark, recorded):
    whole = feeds.feed(spark, **options(recorded))
    late, early = whole.where("day >= date'2024-01-21'"), whole.where("day < date'2024-01-11'")
    assert late.union(early).count() == 160 and late.count() == 80 and whole.count() == 240
    assert late.alias("a").join(early.alias("b"), F.expr("a.station = b.station and a.t = b.t + 86400 * 20")).count() == 80


def test_chunks_and_pads():
    asked = feeds.requests(["a"], date(2024, 1, 1), date(2024, 1, 25), 10, 900)
    assert [(r.from_t // 86400, r.to_t // 86400) for r in asked] == [(19723, 19733), (19733, 19743), (19743, 19748)]
    first, middle, last = asked
    # A sample between two chunks is kept by one of them; the pads stay at the table's ends only.
    for t in range(first.to_t - 900, first.to_t + 900, 300):
        assert first.keeps(t) + middle.keeps(t) == 1
    assert first.keeps(first.from_t - 900) and not first.keeps(first.from_t - 901) and not middle.keeps(middle.from_t - 1)
    assert last.keeps(last.to_t + 899) and not last.keeps(last.to_t + 900)
    assert feeds.requests(["a"], date(2024, 1, 1), date(2024, 1, 25), 10, 900, hi=first.from_t - 900) == [first]


def test_values_that_do_not_parse_are_left_out():
    rows = [("2024-01-01T00:00:00Z", 1), ("2024-01-01T00:00:00+00:00", 2), ("no stamp", 3), ("2024-01-01T01:00:00Z", "x"), ("2024-01-01T02:00:00Z", 100), ("2024-01-01T03:00:00-05:00", "nan"), ("2024-01-01T03:00:00-05:00", "-99.5")]
    zero = feeds._second(date(2024, 1, 1))
    assert feeds.gauge_values(body(rows)) == {zero: 2.0, zero + 8 * 3600: -99.5}
    assert feeds.gauge_values("{}") == {}
    levels = {"data": [{"t": "2024-01-01 00:06", "v": "1.5"}, {"t": "2024-01-01 00:12", "v": ""}, {"t": "x", "v": "1"}, {"t": "2024-01-01 00:18", "v": "31"}, {}]}
    assert feeds.water_level_values(json.dumps(levels)) == {zero + 360: 1.5}
    assert feeds.water_level_values('{"error": {"message": "none"}}') == {}


def test_a_request_is_made_again_and_no_data_gives_no_rows(spark, monkeypatch):
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            seen.append((query["sites"], query["startDT"], query["endDT"]))
            tries = sum(s == seen[-1] for s in seen)
            self.send_response(503 if query["sites"] == "a" and tries < 2 else 200)
            self.end_headers()
            text = '{"error": {"message": "No data was found."}}' if query["sites"] == "none" else body([("2023-12-31T23:50:00Z", 7), ("2024-01-01T00:00:00Z", 1), ("2023-12-31T20:00:00Z", 9)])
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = feeds.feed(spark, base=f"http://127.0.0.1:{server.server_port}/iv", stations="a,none", start="2024-01-01", end="2024-01-02")
        got = sorted((r["station"], r["v"]) for r in rows.collect())
    finally:
        server.shutdown()
    assert got == [("a", 1.0), ("a", 7.0)]
    assert seen.count(("a", "2023-12-31T23:45:00Z", "2024-01-03T00:15:00Z")) == 2 and sum(s[0] == "none" for s in seen) == 1


def archived(spark, path):
    return sorted((r["station"], r["t"], r["v"]) for r in spark.read.schema("station string, t bigint, v double, day date").parquet(path).collect())


def test_late_and_corrected_samples_and_a_batch_that_runs_again(spark, tmp_path):
    base, path, checkpoint = tmp_path / "feed", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    for k, day in enumerate(days("2024-01-01", 10)):
        record(base, "a", day, hours(day, k, 12))
    run = lambda stream, to, at: gauges.archive_days(stream, to, at).trigger(availableNow=True).start().awaitTermination()
    stream = lambda: feeds.feed_stream(spark, base=f"file://{base}", stations="a,b", start="2024-01-01", chunk_days=4)
    run(stream(), path, checkpoint)
    assert len(archived(spark, path)) == 20
    # Two of the last three days are corrected, with samples that came late; four days follow; another station starts.
    for k, day in enumerate(days("2024-01-08", 7)):
        record(base, "a", day, hours(day, 50 + k))
    record(base, "b", "2024-01-09", hours("2024-01-09", 5))
    broken = feeds.feed_stream(spark, base=f"file://{base}", stations="a,b", start="2024-01-01", chunk_days=4)

    def fails(batch, _):
        batch.where("day < date'2024-01-11'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        raise RuntimeError("lost half way")

    with pytest.raises(Exception, match="lost half way"):
        broken.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fails).trigger(availableNow=True).start().awaitTermination()
    run(stream(), path, checkpoint)
    run(stream(), str(tmp_path / "at-once"), str(tmp_path / "at-once-checkpoint"))
    assert archived(spark, path) == archived(spark, str(tmp_path / "at-once")) and len(archived(spark, path)) == 7 * 2 + 7 * 4 + 4


def test_a_stream_asks_from_three_days_before_the_first_new_one():
    one = feeds.FeedStream({"base": "file:///x", "stations": "a", "last_archived": "2024-03-01"})
    assert one.initialOffset() == {"day": "2024-03-02"}
    asked = one.partitions({"day": "2024-03-02"}, {"day": "2024-03-05"})
    assert [(feeds._day(r.from_t), feeds._day(r.to_t - 1)) for r in asked] == [(date(2024, 2, 28), date(2024, 3, 4))]


def test_anchors_close_between_two_samples():
    closed = interpolation.closed
    assert closed(None, 900, 3.0, 900, 3600) == [(900, 3.0)] and closed(None, 901, 3.0, 900, 3600) == []
    assert closed((450, 1.0), 1350, 3.0, 900, 3600) == [(900, 2.0)]
    assert closed((0, 1.0), 1800, 3.0, 900, 3600) == [(900, 2.0), (1800, 3.0)]
    assert closed((0, 1.0), 3601, 3.0, 900, 3600) == [] and closed((0, 1.0), 4500, 3.0, 900, 3600) == [(4500, 3.0)]


def test_state_holds_what_waits_and_one_sample(monkeypatch):
    """Batches in any order give the anchors of all samples in order; what the watermark has passed leaves one sample."""
    import numpy as np
    import pandas as pd

    class Value:
        def __init__(self):
            self.now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, x):
            self.now = x

    class Map(dict):
        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        def removeKey(self, k):  # noqa: N802
            self.pop(k)

        def iterator(self):
            return iter(list(self.items()))

        def keys(self):
            return iter(list(super().keys()))

    class Handle:
        def __init__(self):
            self.timers = set()

        def getMapState(self, *_):  # noqa: N802
            return Map()

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def listTimers(self):  # noqa: N802
            return iter(set(self.timers))

        def deleteTimer(self, t):  # noqa: N802
            self.timers.discard(t)

        def registerTimer(self, t):  # noqa: N802
            self.timers.add(t)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(100_000, 300, replace=False)).tolist()
    v = rng.normal(size=300).tolist()
    want, before = [], None
    for at, level in zip(t, v, strict=True):
        want += interpolation.closed(before, at, level, 900, 2000)
        before = (at, level)
    one, handle, got = interpolation.Brackets(900, 2000), Handle(), []
    one.init(handle)
    late = 20_000
    arrival = sorted(range(300), key=lambda i: t[i] + rng.uniform(0, late))
    top = 0
    for a in range(0, 300, 25):
        part = arrival[a : a + 25]
        list(one.handleInputRows(("s",), iter([pd.DataFrame({"t": [t[i] for i in part], "v": [v[i] for i in part]})]), None))
        top = max(top, *(t[i] for i in part))
        mark = (top - late) * 1000
        assert len(handle.timers) <= 1
        if any(x <= mark for x in handle.timers):
            got += [tuple(r) for f in one.handleExpiredTimer(("s",), Times(mark), None) for r in f[["t", "v"]].itertuples(index=False)]
        assert all(k[0] * 1000 > mark for k in one.waiting.keys())
    got += [tuple(r) for f in one.handleExpiredTimer(("s",), Times(10**9), None) for r in f[["t", "v"]].itertuples(index=False)]
    assert got == want and not list(one.waiting.keys()) and one.last.get() == before


def test_buckets_of_a_series_close_its_anchors_alone():
    """Each bucket with the samples of the gap limit before it gives its own anchors; its state is packed, and goes when the watermark has passed it."""
    import numpy as np
    import pandas as pd

    class Kept(dict):
        puts = 0
        exists = dict.__len__

        def get(self):
            return self[0]

        def update(self, x):
            self[0] = x

        def updateValue(self, k, v):  # noqa: N802
            Kept.puts += 1
            self[k] = v

        def removeKey(self, k):  # noqa: N802
            self.pop(k)

        def iterator(self):
            return iter(list(self.items()))

    class Handle(set):
        getMapState = getValueState = lambda self, *_: Kept()  # noqa: E731, N815
        listTimers = set.copy  # noqa: N815
        deleteTimer, registerTimer = set.discard, set.add  # noqa: N815

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10**9

    rng = np.random.default_rng(5)
    t = np.sort(rng.choice(400_000, 3000, replace=False))
    t = t[(t < 90_000) | (t > 99_000)]
    v = rng.normal(size=len(t))
    want, before = [], None
    for at, level in zip(t.tolist(), v.tolist(), strict=True):
        want += interpolation.closed(before, at, level, 900, 7200)
        before = (at, level)
    got, span = [], 50_000
    for bucket in range(8):
        one, handle = interpolation.Brackets(900, 7200, span), Handle()
        one.init(handle)
        own = rng.permutation(np.flatnonzero((t // span == bucket) | ((t + 7200) // span == bucket)))
        list(one.handleInputRows(("s", bucket), iter([pd.DataFrame({"t": t[own], "v": v[own]})]), None))
        got += [tuple(r) for f in one.handleExpiredTimer(("s", bucket), Times(), None) for r in f[["t", "v"]].itertuples(index=False)]
        assert not one.waiting and not one.last and not handle
    assert sorted(got) == want
    assert Kept.puts < len(t) / 10
