"""DuckDB SQL for the queries of :mod:`brineflow.plans.workloads`."""

from __future__ import annotations

E = "e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, ts, value AS v FROM events)"
G = E + ", g AS (SELECT t, v FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY ts DESC, event_id DESC) = 1)"
Q = (
    G
    + """, b AS (SELECT (min(t) // 86400) * 86400 AS lo, (max(t) // 86400 + 1) * 86400 AS hi FROM g),
a AS (SELECT unnest(generate_series(lo, hi - 900, 900)) AS t FROM b),
p AS (SELECT a.t, g.t AS t0, g.v AS v0 FROM a ASOF LEFT JOIN g ON a.t >= g.t),
n AS (SELECT a.t, g.t AS t1, g.v AS v1 FROM a ASOF LEFT JOIN g ON a.t <= g.t),
q AS (SELECT p.t, round_even((CASE WHEN t0 = p.t THEN v0 WHEN t1 - t0 <= 43200 THEN v0 + (v1 - v0) * ((p.t - t0) / (t1 - t0)) END) * 100, 0)::INT AS level_c FROM p JOIN n USING (t))"""
)
GRID = "g AS (SELECT vec_id AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x, round_even(unnest(embedding)::DOUBLE * 100, 0)::INT AS elev FROM embeddings)"
SIDES = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)"
CONN = (
    GRID
    + f""", k AS (SELECT y, x, elev, x = 0 AND elev <= 0 AS source FROM g),
nb AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2, b.elev AS e2 FROM k a, {SIDES} JOIN k b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.elev <= 25 AND b.elev <= 25),
c AS (SELECT y, x, elev AS s FROM k WHERE source AND elev <= 25 UNION SELECT nb.y2, nb.x2, greatest(c.s, nb.e2) FROM c JOIN nb USING (y, x)),
m AS (SELECT k.*, j.s AS connection FROM k LEFT JOIN (SELECT y, x, min(s) AS s FROM c GROUP BY y, x) j USING (y, x))"""
)
ZONED = (
    CONN
    + f""", z AS (SELECT *, (connection + 100) // 20 AS bin, elev >= 15 AS hard FROM m WHERE connection IS NOT NULL),
zn AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2 FROM z a, {SIDES} JOIN z b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.bin = b.bin AND a.hard = b.hard AND a.y // 25 = b.y // 25 AND a.x // 25 = b.x // 25),
r AS (SELECT y, x, y * 4294967296 + x AS l FROM z UNION SELECT zn.y2, zn.x2, r.l FROM r JOIN zn USING (y, x)),
w AS (SELECT z.*, j.l AS label FROM z JOIN (SELECT y, x, min(l) AS l FROM r GROUP BY y, x) j USING (y, x))"""
)
POINTS = "p AS (SELECT 'r' || n_regionkey AS scenario, (2026 + n_nationkey * 3)::INT AS year, max(n_nationkey * n_nationkey * 13.5::DOUBLE + n_regionkey * 100) AS v FROM nation GROUP BY ALL)"
CURVE = (
    POINTS
    + """, yr AS (SELECT scenario, unnest(range(2026, 2101))::INT AS year FROM (SELECT DISTINCT scenario FROM p)),
lo AS (SELECT yr.*, p.year AS y0, p.v AS v0 FROM yr ASOF LEFT JOIN p ON yr.scenario = p.scenario AND yr.year >= p.year),
hi AS (SELECT yr.*, p.year AS y1, p.v AS v1 FROM yr ASOF LEFT JOIN p ON yr.scenario = p.scenario AND yr.year < p.year),
cv AS (SELECT scenario, year, CASE WHEN y0 IS NULL THEN v1 WHEN year = y0 OR y1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((year - y0) / (y1 - y0)) END AS v FROM lo JOIN hi USING (scenario, year))"""
)
# The rounds of the distance rule: a candidate that is highest among the open ones near it stays, then its neighbours go.
PEAKS = (
    G
    + """, f AS (SELECT t, v, v::FLOAT::DOUBLE AS x, row_number() OVER (ORDER BY t) AS r, coalesce((t - lag(t) OVER (ORDER BY t) > 10800)::INT, 1) AS new FROM g),
s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM (SELECT *, sum(new) OVER (ORDER BY r) AS session FROM f)),
c AS (SELECT *, coalesce((x IS DISTINCT FROM lag(x) OVER (PARTITION BY session ORDER BY r))::INT, 1) AS step FROM s WHERE n >= 12),
u AS (SELECT session, run, min(x) AS x, min(r) AS a, max(r) AS b FROM (SELECT *, sum(step) OVER (PARTITION BY session ORDER BY r) AS run FROM c) GROUP BY session, run),
p AS (SELECT session, (a + b) // 2 AS r, x FROM u QUALIFY x > lag(x) OVER (PARTITION BY session ORDER BY run) AND x > lead(x) OVER (PARTITION BY session ORDER BY run)),
rounds AS (SELECT 0 AS k, session, r, x, 0 AS state FROM p
  UNION ALL SELECT k + 1, session, r, x, CASE WHEN state > 0 THEN state WHEN kept THEN 2 WHEN best = r THEN 1 ELSE 0 END FROM (
    SELECT *, arg_max(CASE WHEN state = 0 THEN r END, (x, r)) FILTER (state = 0) OVER near AS best, bool_or(state = 1) OVER near AS kept, bool_or(state = 0) OVER () AS going
    FROM rounds WINDOW near AS (PARTITION BY session ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE going),
kept AS (SELECT session, r, x FROM rounds WHERE state = 1 AND k = (SELECT max(k) FROM rounds)),
ends AS (SELECT k.session, k.r, max(s.r) FILTER (s.r < k.r AND s.x > k.x) AS a, min(s.r) FILTER (s.r > k.r AND s.x > k.x) AS b FROM kept k JOIN s USING (session) GROUP BY ALL),
base AS (SELECT e.session, e.r, greatest(min(s.x) FILTER (s.r <= e.r AND s.r > coalesce(e.a, 0)), min(s.x) FILTER (s.r >= e.r AND (e.b IS NULL OR s.r < e.b))) AS low FROM ends e JOIN s USING (session) GROUP BY e.session, e.r)"""
)
# Cells of the display grid by their first stage s, and from which stage on (t) the source filter keeps them.
DISPLAY = (
    CONN
    + f""", ps AS (SELECT y // 2 AS y, x // 2 AS x, bool_or(source) AS src FROM m GROUP BY ALL),
q AS (SELECT m.y // 2 AS y, m.x // 2 AS x, elev * 10 AS ground, connection * 10 AS conn, src, CASE WHEN connection IS NOT NULL THEN greatest(0, floor(elev * 2) + 1, connection * 2)::INT END AS s
  FROM m JOIN ps ON ps.y = m.y // 2 AND ps.x = m.x // 2 WHERE m.y % 2 = 1 AND m.x % 2 = 1),
wn AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2, b.s AS s2 FROM q a, {SIDES} JOIN q b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.s <= 280 AND b.s <= 280),
rc AS (SELECT y, x, s FROM q WHERE src AND s <= 280 UNION SELECT wn.y2, wn.x2, greatest(rc.s, wn.s2) FROM rc JOIN wn USING (y, x)),
t AS (SELECT q.*, CASE WHEN src THEN greatest(q.s, near.s) ELSE far.s END AS t FROM q
  LEFT JOIN (SELECT y, x, min(s2) AS s FROM wn GROUP BY ALL) near USING (y, x) LEFT JOIN (SELECT y, x, min(s) AS s FROM rc GROUP BY ALL) far USING (y, x))"""
)
LEVELS = E + ", lv AS (SELECT round_even(v * 100, 0)::INT AS level FROM e)"


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _r(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


SQL = {
    "gauge_dedupe_second": _w(G, "SELECT t, v FROM g"),
    "quarter_hour_interp": _w(Q, "SELECT t, level_c FROM q"),
    "daily_class": _w(Q, "SELECT (DATE '1970-01-01' + (t // 86400)::INT)::DATE AS day, max(level_c) AS peak_c, CASE WHEN max(level_c) / 100.0 >= 300 THEN 'major' WHEN max(level_c) / 100.0 >= 200 THEN 'moderate' WHEN max(level_c) / 100.0 >= 100 THEN 'minor' ELSE 'none' END AS class, count(level_c) AS n_valid, count(*) AS n_slots FROM q GROUP BY t // 86400"),
    "hourly_argmax": _w(E, "SELECT t // 3600 AS hour, event_id, v FROM e QUALIFY row_number() OVER (PARTITION BY t // 3600 ORDER BY v DESC, ts, event_id) = 1"),
    "phase_per_user": _w(E, ", c AS (SELECT event_id, user_id, t // 86400 AS day, ts, round_even(v * 100, 0)::INT AS c FROM e), d AS (SELECT event_id, c - lag(c) OVER w AS b, lead(c) OVER w - c AS a FROM c WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)) SELECT event_id, CASE WHEN least(a, b) > 2.5 THEN 'filling' WHEN greatest(a, b) < -2.5 THEN 'draining' ELSE 'slack' END AS phase FROM d"),
    "rise_rate": _w(E, ", c AS (SELECT event_id, user_id, ts, round_even(v * 100, 0)::INT AS c FROM e) SELECT event_id, coalesce((c - lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 4.0::DOUBLE, 0.0) AS rise_c FROM c"),
    "gap_sessions": _w(E, ", s AS (SELECT user_id, t, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600)::INT, 0) AS new FROM e), n AS (SELECT user_id, t, (sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM s) SELECT user_id, session, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows FROM n GROUP BY ALL HAVING count(*) >= 2"),
    "peak_events": _r(PEAKS, "SELECT s.t, s.v FROM kept JOIN base USING (session, r) JOIN s USING (session, r) WHERE kept.x - base.low >= 20"),
    "local_maxima": _w(E, "SELECT event_id, user_id, v FROM e QUALIFY v > lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND v > lead(v) OVER (PARTITION BY user_id ORDER BY ts, event_id)"),
    "exceedance_counts": _w(LEVELS, "SELECT th AS threshold_c, count(level)::BIGINT AS n_at_or_above FROM (SELECT unnest(range(0, 56200, 200)) AS th) LEFT JOIN lv ON level >= th GROUP BY th"),
    "year_interp": _w(CURVE, "SELECT scenario, year, round_even(v, 0)::INT AS rise_c FROM cv"),
    "rise_from_base": _w(CURVE, "SELECT a.scenario, a.year, round_even(a.v - b.v, 0)::INT AS delta_c FROM cv a JOIN cv b ON a.scenario = b.scenario AND b.year = 2040"),
    "exceedance_cube": _w(CURVE + ", " + LEVELS, ", k AS (SELECT scenario, year, e.elev AS elev_c, e.elev - round_even(v, 0)::INT AS th FROM cv, (SELECT unnest(range(0, 56200, 200))::INT AS elev) e), n AS (SELECT th, count(level) AS n FROM (SELECT DISTINCT th FROM k) LEFT JOIN lv ON level >= th GROUP BY th), a AS (SELECT k.*, least(70500, round_even(n * 70500.0::DOUBLE / (SELECT count(level) FROM lv), 0)::INT) AS annual_c FROM k JOIN n USING (th)) SELECT scenario, elev_c, sum(annual_c)::BIGINT AS all_years_c, max(annual_c) AS most_c FROM a GROUP BY ALL"),
    "crest_ranking": "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%B %-d, %Y') AS display_date FROM orders WHERE o_totalprice >= 250000 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey",
    "crest_top10": "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%B %-d, %Y') AS display_date FROM orders WHERE o_totalprice >= 250000 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 10",
    "calibrate_day": _w(E, ", b AS (SELECT event_id, v, min(v) OVER (PARTITION BY t // 86400) AS lo, max(v) OVER (PARTITION BY t // 86400) AS hi FROM e) SELECT event_id, round_even((CASE WHEN hi > lo THEN lo + (v - lo) * (250.0::DOUBLE - lo) / (hi - lo) ELSE v END) * 100, 0)::INT AS level_c FROM b"),
    "compact_day_array": _w(Q, "SELECT t // 86400 AS day, string_agg(coalesce(level_c::VARCHAR, 'null'), ',' ORDER BY t) AS v, count(*)::BIGINT AS n_slots, count(level_c)::BIGINT AS n_valid FROM q GROUP BY t // 86400"),
    "compact_roundtrip": _w(Q, "SELECT t, level_c FROM q WHERE level_c IS NOT NULL"),
    "stage_key": _w(E, ", s AS (SELECT event_id, v / 20 - 3 AS x FROM e) SELECT event_id, printf('%.2f', floor((least(14.0::DOUBLE, greatest(-2.0::DOUBLE, x)) + 1e-9::DOUBLE) * 20) / 20) AS key, x < -2 OR x > 14 AS clamped, (CASE WHEN floor(x * 20) < 0 THEN 'm' ELSE 'p' END) || printf('%04d', abs(floor(x * 20) * 5)::INT) AS code FROM s"),
    "depth_penalty": _w(E, ", s AS (SELECT event_id, floor(v) / 20 AS st, (event_id % 50) / 10.0::DOUBLE AS gr FROM e), p AS (SELECT *, CASE WHEN st <= 3.25 THEN 1.25::DOUBLE WHEN st >= 5.25 THEN 0.0 ELSE 1.25::DOUBLE * (exp(-1.5::DOUBLE * ((st - 3.25::DOUBLE) / 2.0::DOUBLE)) - exp(-1.5::DOUBLE)) / (1 - exp(-1.5::DOUBLE)) END AS pen, greatest(0.0::DOUBLE, st - gr) AS raw FROM s), d AS (SELECT event_id, pen, round_even((raw - least(pen, 0.75::DOUBLE * raw)) * 1000, 0)::INT AS depth_m FROM p) SELECT event_id, round_even(pen * 1000, 0)::INT AS penalty_m, depth_m, (1 + (depth_m >= 100)::INT + (depth_m >= 250)::INT + (depth_m >= 500)::INT + (depth_m >= 1000)::INT + (depth_m >= 1500)::INT + (depth_m >= 2000)::INT + (depth_m >= 2500)::INT + (depth_m >= 3000)::INT + (depth_m >= 4000)::INT + (depth_m >= 5000)::INT)::INT AS code FROM d"),
    "packed_lookup": _w(GRID, "SELECT y, x, ((elev + 32768) >> 8) & 255 AS r, (elev + 32768) & 255 AS g, CASE WHEN elev * 4 BETWEEN -100 AND 154 THEN elev * 4 + 100 ELSE 255 END AS b, 255 AS a FROM g"),
    "raster_mask_condition": _w(GRID, "SELECT y, x, CASE WHEN (y + x) % 7 = 0 THEN greatest(elev, 8) ELSE elev END AS elev, (y + x) % 7 = 0 AS hard FROM g"),
    "raster_dilate": _w(GRID, ", o AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4))::INT AS dy), (SELECT unnest(range(-3, 4))::INT AS dx) WHERE dy * dy + dx * dx <= 9) SELECT DISTINCT y + dy AS y, x + dx AS x FROM g, o WHERE elev >= 30"),
    "raster_or_pool": _w(GRID, "SELECT (y // 5)::INT AS by, (x // 5)::INT AS bx, bool_or(elev >= 25) AS wet FROM g GROUP BY ALL"),
    "raster_edges": _w(GRID, ", k AS (SELECT y, x, elev, (y // 10) * 1000 + x // 10 AS z FROM g), p AS (SELECT a.z AS za, b.z AS zb, greatest(a.elev, b.elev) AS crest FROM k a JOIN k b ON (b.y = a.y AND b.x = a.x + 1) UNION ALL SELECT a.z, b.z, greatest(a.elev, b.elev) FROM k a JOIN k b ON (b.y = a.y + 1 AND b.x = a.x)) SELECT least(za, zb) AS zone_a, greatest(za, zb) AS zone_b, crest, count(*) AS width FROM p WHERE za <> zb GROUP BY ALL"),
    "raster_components": _r(GRID, f", k AS (SELECT * FROM g WHERE elev <= -1), nb AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2 FROM k a, {SIDES} JOIN k b ON b.y = a.y + dy AND b.x = a.x + dx), r AS (SELECT y, x, y * 4294967296 + x AS l FROM k UNION SELECT nb.y2, nb.x2, r.l FROM r JOIN nb USING (y, x) WHERE nb.y2 * 4294967296 + nb.x2 > r.l), m AS (SELECT y, x, min(l) AS l FROM r GROUP BY y, x) SELECT l // 4294967296 AS y, l % 4294967296 AS x, count(*) AS n_cells, min(elev) AS lowest FROM m JOIN k USING (y, x) GROUP BY l HAVING count(*) >= 3"),
    "connection_stage": _r(CONN, "SELECT y, x, connection FROM m"),
    "zone_summary": _r(ZONED, ", hb AS (SELECT label, elev + 100 AS bin, count(*) AS n FROM w GROUP BY ALL), hs AS (SELECT label, string_agg(bin || ':' || n, ' ' ORDER BY bin) AS hist FROM hb GROUP BY label) SELECT label // 4294967296 AS y, label % 4294967296 AS x, max(connection) AS connection, count(*) AS cell_count, count(*) FILTER (source) AS source_cells, count(*) FILTER (hard) AS hard_cells, any_value(hist) AS hist FROM w JOIN hs USING (label) GROUP BY label"),
    "stage_wet_cells": _r(CONN, "SELECT st AS stage_c, count(*) FILTER (st > elev * 10 AND coalesce(connection * 10 <= st, false)) AS n_wet, count(*) FILTER (elev * 10 <= st AND NOT (st > elev * 10 AND coalesce(connection * 10 <= st, false))) AS n_low FROM m, (SELECT unnest(range(0, 1405, 5))::INT AS st) GROUP BY st"),
    "render_stages": _r(
        DISPLAY,
        """SELECT k * 5 AS stage_c, count(*) FILTER (s <= k AND t <= k) AS n_wet, count(*) FILTER (ground <= k * 5 AND NOT coalesce(s <= k AND t <= k, false)) AS n_green,
count(*) FILTER (s <= k AND NOT coalesce(t <= k, false)) AS n_removed FROM t, (SELECT unnest(range(281))::INT AS k) GROUP BY k""",
    ),
    "render_codes": _r(
        DISPLAY,
        """, kept AS (SELECT y, x, ground, conn, greatest(0, (150 - ground) / 100.0::DOUBLE) AS raw FROM t WHERE t <= 30 AND s <= 30),
d AS (SELECT *, raw - least(1.25::DOUBLE, 0.75::DOUBLE * raw) AS depth FROM kept),
o AS (SELECT d AS o, exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) * (d / 2.0::DOUBLE)) AS w FROM (SELECT unnest(range(-8, 9)) AS d)),
b AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM q),
ty AS (SELECT y, least(greatest(y + o, y0), y1) AS at, w FROM (SELECT DISTINCT y FROM d), o, b),
tx AS (SELECT x, least(greatest(x + o, x0), x1) AS at, w FROM (SELECT DISTINCT x FROM d), o, b),
v AS (SELECT ty.y, d.x, sum(depth * w) AS n, sum(w) AS m FROM ty JOIN d ON d.y = ty.at GROUP BY ALL),
h AS (SELECT v.y, tx.x, sum(n * w) / sum(m * w) AS depth FROM tx JOIN v ON v.x = tx.at GROUP BY ALL),
z AS (SELECT d.y, d.x, h.depth, greatest(ground, conn) AS act FROM d JOIN h USING (y, x))
SELECT y, x, 1 + len(list_filter([0.1, 0.25, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5], lambda e: round(depth, 9) >= e))::INT AS depth_code,
  CASE WHEN act < 325 THEN 1 WHEN act < 425 THEN 2 ELSE 3 END AS stage_code, round_even(depth * 1000, 0)::INT AS depth_m FROM z
UNION ALL SELECT y, x, 12, 4, NULL FROM q WHERE ground <= 150 AND (y, x) NOT IN (SELECT (y, x) FROM kept)""",
    ),
    "render_source_filter": _r(GRID, f", k AS (SELECT * FROM g WHERE elev <= 2), nb AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2 FROM k a, {SIDES} JOIN k b ON b.y = a.y + dy AND b.x = a.x + dx), r AS (SELECT y, x FROM k WHERE x < 3 UNION SELECT nb.y2, nb.x2 FROM r JOIN nb USING (y, x)) SELECT y, x FROM r SEMI JOIN nb USING (y, x)"),
    "green_next_to_blue": _w(GRID, f"SELECT DISTINCT a.y, a.x FROM g a, {SIDES} JOIN g b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.elev > 2 AND a.elev <= 6 AND b.elev <= 2"),
    "smoothed_depth": _w(
        GRID,
        """, k AS (SELECT y, x, elev::DOUBLE AS n FROM g WHERE elev <= 10),
o AS (SELECT d AS o, exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) * (d / 2.0::DOUBLE)) AS w FROM (SELECT unnest(range(-8, 9)) AS d)),
b AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM g),
ty AS (SELECT y, least(greatest(y + o, y0), y1) AS at, w FROM (SELECT DISTINCT y FROM k), o, b),
tx AS (SELECT x, least(greatest(x + o, x0), x1) AS at, w FROM (SELECT DISTINCT x FROM k), o, b),
v AS (SELECT ty.y, k.x, sum(n * w) AS n, sum(w) AS d FROM ty JOIN k ON k.y = ty.at GROUP BY ALL),
h AS (SELECT v.y, tx.x, sum(n * w) AS n, sum(d * w) AS d FROM tx JOIN v ON v.x = tx.at GROUP BY ALL)
SELECT k.y, k.x, round_even(h.n / h.d * 100, 0)::INT AS smooth_c FROM k JOIN h USING (y, x)""",
    ),
    "scalar_formats": "WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus, (o_orderkey % 2700)::VARCHAR AS s FROM orders), f AS (SELECT *, CASE WHEN length(s) = 3 THEN '0' || s WHEN length(s) >= 4 THEN s[1:4] END AS h FROM o) SELECT o_orderkey, CASE WHEN regexp_full_match(h, '([01][0-9]|2[0-3])[0-5][0-9]') THEN h[1:2] || ':' || h[3:4] END AS time, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, nullif(o_orderstatus, '') AS status FROM f",
    "tumbling_hours": _w(E, "SELECT t // 3600 AS hour, count(*) AS n, max(round_even(v * 100, 0)::INT) AS peak_c FROM e GROUP BY 1"),
    "hour_anchor_nearest_fill": _w("f AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t, value AS v FROM events)", ", k AS (SELECT event_id, user_id, t, v, round_even(t / 3600, 0)::BIGINT * 3600 AS anchor, event_type IS NOT DISTINCT FROM 'signup' AS known FROM f) SELECT user_id, anchor, event_id, abs(t - anchor) AS dist, v FROM k WHERE NOT known AND NOT EXISTS (SELECT 1 FROM k x WHERE x.known AND x.user_id = k.user_id AND x.anchor = k.anchor) QUALIFY row_number() OVER (PARTITION BY user_id, anchor ORDER BY abs(t - anchor), t, event_id) = 1"),
    "missing_anchors": _w(E, ", x AS (SELECT unnest(generate_series(min(t) // 3600, max(t) // 3600)) AS hour FROM e) SELECT hour, date_trunc('month', DATE '1970-01-01' + (hour // 24)::INT)::DATE AS month FROM x WHERE hour NOT IN (SELECT t // 3600 FROM e)"),
    "upsert_days": _w("d AS (SELECT user_id, floor(epoch(ts))::BIGINT // 86400 AS day, round_even(value * 100, 0)::INT AS c, event_type IS NOT DISTINCT FROM 'purchase' AS anew FROM events)", ", o AS (SELECT user_id, day, max(c) AS peak_c, count(*) AS n FROM d WHERE NOT anew GROUP BY ALL), w AS (SELECT user_id, day, max(c) AS peak_c, count(*) AS n FROM d WHERE anew GROUP BY ALL) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = o.user_id AND w.day = o.day) UNION ALL SELECT * FROM w"),
    "equilibrium_storage": _r(ZONED, ", zc AS (SELECT label, max(connection) AS c FROM w GROUP BY label), hb AS (SELECT label, elev, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT st, zc.label, sum(CASE WHEN elev * 10 <= st THEN n ELSE 0 END) AS wet, sum(CASE WHEN elev * 10 <= st THEN n * (st - elev * 10) ELSE 0 END) AS vol FROM zc, (SELECT unnest(range(0, 1405, 5)) AS st) JOIN hb ON hb.label = zc.label WHERE zc.c * 10 <= st GROUP BY ALL) SELECT st::INT AS stage_c, count(*) AS n_zones, sum(wet)::BIGINT AS wet_cells, sum(vol)::BIGINT AS storage_c FROM s GROUP BY st"),
    "ring_nearest_valid": _w(GRID, ", o AS (SELECT dy, dx FROM (SELECT unnest(range(-10, 11))::INT AS dy), (SELECT unnest(range(-10, 11))::INT AS dx)), near AS (SELECT g.y - dy AS py, g.x - dx AS px, g.y, g.x, greatest(abs(dy), abs(dx))::INT AS radius, (dy * dy + dx * dx)::INT AS d2 FROM g, o WHERE g.elev >= 20) SELECT p.y * 64 + p.x AS pid, radius, d2, near.y, near.x FROM near JOIN g p ON p.y = near.py AND p.x = near.px QUALIFY row_number() OVER (PARTITION BY p.y, p.x ORDER BY radius, d2, near.y, near.x) = 1"),
}
