"""Archive plans over the driver's tables, each with its SQL.

``events`` are samples of gauges named by ``event_type``, ``orders`` crest records.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.functions import levels as L
from brineflow.operators import series
from brineflow.plans import archives
from brineflow.runtime import table
from brineflow.sources import readers

ZONE = "America/New_York"
EXCLUDED = date(1996, 3, 2)


def _gauges(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), L.epoch_s(F.col("ts")).alias("t"), "ts", "event_id", F.col("value").alias("v"))
    return series.dedupe(e, ["series", "t"], ["ts", "event_id"])


def _days(spark, d) -> DataFrame:
    return archives.compact_days(_gauges(spark, d), zone=ZONE)


def _joined(v: str):
    return F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")


def civil_compact_days(spark, d):
    return _days(spark, d).select("series", "d", "u", "p", "c", F.size("v").cast("long").alias("n_slots"), _joined("v").alias("v"))


def civil_hourly_rows(spark, d):
    g = _gauges(spark, d)
    rows = archives.hourly_rows(g, archives.civil_slots(archives.civil_days(g, ZONE), ZONE, 3600))
    return rows.select("series", "d", F.col("pos").cast("long").alias("pos"), "t", "navd_c", "mllw_c", "phase", L.utc_stamp(F.col("hour")).alias("utc"))


def civil_hourly_days(spark, d):
    """``signup`` samples are the hourly record of the one series, all other samples the finer feed that fills it."""
    g = _gauges(spark, d).withColumn("on_record", F.col("series").eqNullSafe("signup"))
    one = g.groupBy("t", "on_record").agg(F.min_by("v", "series").alias("v")).withColumns({"series": F.lit("all"), "ord": F.lit(0)})
    none = one.select("series", F.col("t").alias("anchor")).limit(0)
    record = series.nearest_fill(one.where("on_record"), none)
    fills = series.nearest_fill(one.where("not on_record"), record)
    hours = record.unionByName(fills).select("series", F.col("anchor").alias("t"), L.centi(F.col("v")).alias("x"))
    slots = archives.civil_slots(archives.civil_days(hours, ZONE), ZONE, 3600)
    days = archives.hourly_days(hours, slots, fills)
    return days.select("d", "u", "p", "c", _joined("v").alias("v"), F.coalesce(_joined("x"), F.lit("")).alias("x"))


def hourly_peak_or_quarter(spark, d):
    g = _gauges(spark, d)
    hourly = archives.hourly_rows(g, archives.civil_slots(archives.civil_days(g, ZONE), ZONE, 3600)).groupBy("series", "d").agg(F.max("navd_c").alias("hour_c"))
    days = _days(spark, d).join(hourly, ["series", "d"], "left")
    return days.select("series", "d", archives.peak_or(F.col("hour_c"), F.col("p")).alias("peak_c"))


def rederived_days(spark, d):
    """Days of one gauge with another's arrays laid over the days where its peak is higher; peak and class anew."""
    days = _days(spark, d)
    base = days.where("series = 'view'").select("d", "v", F.lit("record").alias("s"))
    over = days.where("series = 'error'").select("d", "v", F.col("p").alias("p2"), F.lit("overlay").alias("s")).join(days.where("series = 'view'").select("d", "p"), "d").where("p2 > p").select("d", "v", "s")
    return archives.rederived(base, over).select("d", "p", "c", "s", _joined("v").alias("v"))


def day_slot_phases(spark, d):
    return archives.windowed_phase(_days(spark, d)).select("series", "d", F.col("pos").cast("long").alias("pos"), "x", "phase")


def archive_quality(spark, d):
    return archives.quality(_days(spark, d)).select("first_day", "last_day", F.col("n_filled").cast("long").alias("n_filled"), F.col("n_slots").cast("long").alias("n_slots"))


def latest_days(spark, d):
    """The last seven days of one gauge: a report of fixed length."""
    return archives.latest_first(_days(spark, d).where("series = 'click'"), 7).select("d", "p")


def refetch_ranges(spark, d):
    return archives.lagged_range(_days(spark, d))


def clipped_day_range(spark, d):
    return archives.clipped_days(_days(spark, d), date(2024, 1, 3), date(2024, 1, 20)).select("series", "d", "p")


def forecast_hours(spark, d):
    """Each user's events in order as the hours of a forecast."""
    e = table(spark, d, "events")
    hours = e.select(F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("pos"), "event_id", (F.col("value") / 25 - 4).alias("mllw"))
    rows = archives.forecast_rows(hours)
    return rows.select("event_id", F.rint(F.col("navd") * 100).cast("int").alias("navd_c"), "stage_key", "clamped", "phase", F.rint(F.col("rise") * 10000).cast("int").alias("rise_e4"))


def missing_months(spark, d):
    """Months that lack a day with an urgent order."""
    o = table(spark, d, "orders").select(F.expr("datediff(o_orderdate, date'1970-01-01') * 24L").alias("hour"), "o_orderpriority")
    expected = o.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.lit(24).cast("long"))).alias("hour"))
    return archives.missing_months(expected, o.where("o_orderpriority = '1-URGENT'").select("hour").distinct())


def _records(spark, d) -> DataFrame:
    """Orders in the fields of a peak feed, as strings."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    height = F.format_string("%.2f", F.rint(F.col("o_totalprice") / 600) / 100)
    odd = F.col("o_orderkey") % 2 == 1
    return o.select(
        "o_orderkey", "o_orderstatus",
        F.when(odd, "").otherwise(day).alias("ag_dt"), F.when(odd, day).alias("peak_dt"),
        F.when(odd, "x").otherwise(height).alias("ag_gage_ht"), F.when(odd, height).alias("gage_ht"),
        F.lit(None).cast("string").alias("ag_tm"), F.expr("cast(o_orderkey % 2700 as string)").alias("peak_tm"),
    )


def parsed_crests(spark, d):
    """Orders as crests: filled fields chosen, least height, times and dates for show."""
    rows = archives.crest_rows(_records(spark, d))
    return rows.select(F.rint(F.col("height_ft") * 100).cast("int").alias("height_c"), "date", "time_est", "display_date")


def crest_overlay(spark, d):
    """Parsed crests and a manual list, without the excluded date's but for the calibrated ones."""
    records = _records(spark, d)
    parsed = archives.crest_rows(records.where("not o_orderstatus <=> 'P'"))
    manual = archives.crest_rows(records.where("o_orderstatus = 'P'")).withColumns({"source_area": F.when(F.dayofmonth("date") % 2 == 0, "calibrated").otherwise("other"), "station_priority": F.dayofmonth("date").cast("int")})
    return archives.crest_table(parsed, manual, EXCLUDED).select(F.rint(F.col("height_ft") * 100).cast("int").alias("height_c"), "date", "source_area", "station_priority")


def request_chunks(spark, d):
    """Fetch ranges of 90 days with a pad of 15 minutes, and their requests, for each priority's span of orders."""
    spans = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    rows = readers.padded_chunks(spans, "lo", "hi")
    url = readers.request_url("https://feed.test/iv", site=F.col("o_orderpriority"), startDT=L.utc_stamp(F.col("from_t")), endDT=L.utc_stamp(F.col("to_t")))
    return rows.select("o_orderpriority", "nth", "from_t", "to_t", url.alias("url"))


S = "s AS (SELECT series, t, v FROM (SELECT event_type AS series, floor(epoch(ts))::BIGINT AS t, ts, event_id, value AS v FROM events) QUALIFY row_number() OVER (PARTITION BY series, t ORDER BY ts DESC, event_id DESC) = 1)"
Z = f"AT TIME ZONE '{ZONE}'"


def _civil(source: str, step: int, name: str = "sl") -> str:
    return f"""{name}b AS (SELECT series, (to_timestamp(min(t)) {Z})::DATE AS lo, (to_timestamp(max(t)) {Z})::DATE AS hi FROM {source} GROUP BY series),
{name}d AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM {name}b),
{name}u AS (SELECT series, d, epoch(d::TIMESTAMP {Z})::BIGINT AS u, epoch((d + 1)::TIMESTAMP {Z})::BIGINT AS nxt FROM {name}d),
{name} AS (SELECT series, d, u, t, (t - u) // {step} AS pos FROM (SELECT series, d, u, unnest(generate_series(u, nxt - {step}, {step})) AS t FROM {name}u))"""


FILLED = (
    S
    + ", "
    + _civil("s", 900)
    + """, p AS (SELECT sl.*, s.t AS t0, s.v AS v0 FROM sl ASOF LEFT JOIN s ON sl.series = s.series AND sl.t >= s.t),
n AS (SELECT sl.series, sl.t, s.t AS t1, s.v AS v1 FROM sl ASOF LEFT JOIN s ON sl.series = s.series AND sl.t <= s.t),
q AS (SELECT p.series, d, u, pos, p.t, round_even((CASE WHEN t0 = p.t THEN v0 WHEN t1 - t0 <= 43200 THEN v0 + (v1 - v0) * ((p.t - t0) / (t1 - t0)) END) * 100, 0)::INT AS x FROM p JOIN n USING (series, t))"""
)
CLASS = "CASE WHEN max(x) / 100.0::DOUBLE >= 5.25 THEN 'major' WHEN max(x) / 100.0::DOUBLE >= 4.25 THEN 'moderate' WHEN max(x) / 100.0::DOUBLE >= 3.25 THEN 'minor' ELSE 'none' END"
TEXT = "string_agg(coalesce(x::VARCHAR, 'null'), ',' ORDER BY pos)"
DAYS = FILLED + f", dy AS (SELECT series, d, u, max(x) AS p, {CLASS} AS c, count(*)::BIGINT AS n_slots, count(x)::BIGINT AS n_filled, {TEXT} AS v FROM q GROUP BY ALL HAVING max(x) IS NOT NULL)"
HOURS = S + ", " + _civil("s", 3600) + """, hb AS (SELECT sl.series, sl.d, sl.pos, sl.t AS hour, s.t, s.v FROM s JOIN sl ON s.series = sl.series AND s.t // 3600 * 3600 = sl.t QUALIFY row_number() OVER (PARTITION BY s.series, sl.t ORDER BY s.v DESC, s.t) = 1),
hr AS (SELECT *, round_even((v + 1e-9::DOUBLE) * 100, 0)::INT AS navd_c, round_even((v + 1e-9::DOUBLE) * 100, 0)::INT + 275 AS mllw_c FROM hb)"""
HALF = "floor((value / 25 - 4 + (-2.75)::DOUBLE + 2.220446049250313e-16::DOUBLE) * 100 + 0.5::DOUBLE) / 100"
REC = """r AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS ds, (round_even(o_totalprice / 600, 0) / 100)::DOUBLE AS h, (o_orderkey % 2700)::VARCHAR AS tm FROM orders),
f AS (SELECT o_orderstatus, h AS height_ft, ds::DATE AS date, CASE WHEN length(tm) = 3 THEN '0' || tm WHEN length(tm) >= 4 THEN tm[1:4] END AS four FROM r WHERE h >= 3.25)"""

SQL = {
    "civil_compact_days": f"WITH {DAYS} SELECT series, d, u, p, c, n_slots, v FROM dy",
    "civil_hourly_rows": f"WITH {HOURS}, k AS (SELECT *, navd_c - lag(navd_c) OVER w AS b, lead(navd_c) OVER w - navd_c AS a FROM hr WINDOW w AS (PARTITION BY series, d ORDER BY hour)) SELECT series, d, pos, t, navd_c, mllw_c, CASE WHEN least(a, b) > 2.5 THEN 'filling' WHEN greatest(a, b) < -2.5 THEN 'draining' ELSE 'slack' END AS phase, strftime(make_timestamp(hour * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM k",
    "civil_hourly_days": "WITH " + S + """, o AS (SELECT t, series IS NOT DISTINCT FROM 'signup' AS rec, arg_min(v, series) AS v FROM s GROUP BY ALL),
a AS (SELECT *, round_even(t / 3600, 0)::BIGINT * 3600 AS anchor FROM o),
nr AS (SELECT rec, anchor, v FROM a QUALIFY row_number() OVER (PARTITION BY rec, anchor ORDER BY abs(t - anchor), t) = 1),
h AS (SELECT 'all' AS series, anchor AS t, round_even(v * 100, 0)::INT AS level, NOT rec AS fill FROM nr WHERE rec OR anchor NOT IN (SELECT anchor FROM nr WHERE rec)), """
    + _civil("h", 3600)
    + f", q AS (SELECT sl.d, sl.u, sl.pos, h.level AS x, h.fill FROM sl LEFT JOIN h ON sl.t = h.t) SELECT d, u, max(x) AS p, {CLASS} AS c, {TEXT} AS v, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (fill), '') AS x FROM q GROUP BY d, u HAVING max(x) IS NOT NULL",
    "hourly_peak_or_quarter": f"WITH {DAYS}, " + HOURS[len(S) + 2 :].replace("slb", "hlb").replace("sld", "hld").replace("slu", "hlu").replace("sl AS", "hl AS").replace("JOIN sl", "JOIN hl").replace("sl.", "hl.") + ", hp AS (SELECT series, d, max(navd_c) AS hour_c FROM hr GROUP BY ALL) SELECT dy.series, dy.d, coalesce(hour_c, p) AS peak_c FROM dy LEFT JOIN hp USING (series, d)",
    "rederived_days": f"WITH {DAYS}, a AS (SELECT * FROM dy WHERE series = 'view'), o AS (SELECT e.* FROM dy e JOIN a USING (d) WHERE e.series = 'error' AND e.p > a.p) SELECT d, coalesce(o.p, a.p) AS p, coalesce(o.c, a.c) AS c, CASE WHEN o.p IS NULL THEN 'record' ELSE 'overlay' END AS s, coalesce(o.v, a.v) AS v FROM a LEFT JOIN o USING (d)",
    "day_slot_phases": f"WITH {FILLED}, k AS (SELECT series, d, pos, x, x - lag(x) OVER w AS b, lead(x) OVER w - x AS a FROM q WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series, d ORDER BY pos)) SELECT series, d, pos, x, CASE WHEN least(a, b) > 2.5 THEN 'filling' WHEN greatest(a, b) < -2.5 THEN 'draining' ELSE 'slack' END AS phase FROM k",
    "archive_quality": f"WITH {DAYS} SELECT min(d) AS first_day, max(d) AS last_day, sum(n_filled)::BIGINT AS n_filled, sum(n_slots)::BIGINT AS n_slots FROM dy",
    "latest_days": f"WITH {DAYS} SELECT d, p FROM dy WHERE series = 'click' ORDER BY d DESC LIMIT 7",
    "refetch_ranges": f"WITH {DAYS} SELECT series, (max(d) - 3)::DATE AS start FROM dy GROUP BY series",
    "clipped_day_range": f"WITH {DAYS} SELECT series, d, p FROM dy WHERE d >= DATE '2024-01-03' AND d < DATE '2024-01-20'",
    "forecast_hours": f"WITH n AS (SELECT event_id, user_id, ts, {HALF} AS navd FROM events), c AS (SELECT *, round_even(navd * 100, 0)::INT AS c, lag(navd) OVER w AS before, navd - lag(navd) OVER w AS rise FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, c - lag(c) OVER w AS b, lead(c) OVER w - c AS a FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, c AS navd_c, printf('%.2f', floor((least(14.0::DOUBLE, greatest(-2.0::DOUBLE, navd)) + 1e-9::DOUBLE) * 20) / 20) AS stage_key, navd < -2 OR navd > 14 AS clamped, CASE WHEN least(a, b) > 2.5 THEN 'filling' WHEN greatest(a, b) < -2.5 THEN 'draining' ELSE 'slack' END AS phase, round_even(coalesce(rise / 4.0::DOUBLE, 0) * 10000, 0)::INT AS rise_e4 FROM k",
    "missing_months": "WITH o AS (SELECT o_orderdate::DATE AS d, o_orderpriority AS p FROM orders), x AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM o) SELECT DISTINCT date_trunc('month', d)::DATE AS month FROM x WHERE d NOT IN (SELECT d FROM o WHERE p = '1-URGENT')",
    "parsed_crests": f"WITH {REC} SELECT round_even(height_ft * 100, 0)::INT AS height_c, date, CASE WHEN regexp_full_match(four, '([01][0-9]|2[0-3])[0-5][0-9]') THEN four[1:2] || ':' || four[3:4] END AS time_est, strftime(date, '%B %-d, %Y') AS display_date FROM f",
    "crest_overlay": f"WITH {REC}, m AS (SELECT height_ft, date, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN day(date) % 2 = 0 THEN 'calibrated' ELSE 'other' END END AS source_area, CASE WHEN o_orderstatus = 'P' THEN day(date)::INT END AS station_priority FROM f) SELECT round_even(height_ft * 100, 0)::INT AS height_c, date, source_area, station_priority FROM m WHERE date <> DATE '{EXCLUDED}' OR source_area = 'calibrated'",
    "request_chunks": "WITH b AS (SELECT o_orderpriority, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, hi, unnest(generate_series(lo, hi, INTERVAL 90 DAY))::DATE AS d FROM b), k AS (SELECT o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY d) - 1)::INT AS nth, epoch(d)::BIGINT - 900 AS from_t, epoch(least(d + 90, hi + 1))::BIGINT + 900 AS to_t FROM c) SELECT *, 'https://feed.test/iv?site=' || replace(replace(o_orderpriority, '%', '%25'), ' ', '+') || '&startDT=' || replace(strftime(make_timestamp(from_t * 1000000), '%Y-%m-%dT%H:%M:%SZ'), ':', '%3A') || '&endDT=' || replace(strftime(make_timestamp(to_t * 1000000), '%Y-%m-%dT%H:%M:%SZ'), ':', '%3A') AS url FROM k",
}
QUERIES = {name: globals()[name] for name in SQL}
