"""Scalar expressions on levels, stages, depths and stamps; all built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from brineflow import config as C


def finite(x: Column, limit: float = 100.0) -> Column:
    """A level that is a number within the instrument's range, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < limit), x)


def parsed_level(s: Column, low: float = -30.0, high: float = 30.0) -> Column:
    v = s.try_cast("double")
    return F.when(~F.isnan(v) & v.between(low, high), v)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def classify(x: Column, minor: float = C.FLOOD_FT["minor"], moderate: float = C.FLOOD_FT["moderate"], major: float = C.FLOOD_FT["major"]) -> Column:
    """Flood class; null and NaN are ``none`` (NaN would sort above all numbers)."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), "none").when(x >= major, "major").when(x >= moderate, "moderate").when(x >= minor, "minor").otherwise("none")


def centi(x: Column) -> Column:
    """Hundredths, half to even."""
    return F.rint(x * 100).cast("int")


def to_mllw_c(navd_c: Column) -> Column:
    """Hundredths over the other datum, from those that are kept: no second rounding."""
    return (navd_c - round(C.MLLW_OFFSET_FT * 100)).cast("int")


def half_up_2(x: Column) -> Column:
    """Two digits, halves towards plus infinity."""
    return F.floor((x + 2.220446049250313e-16) * 100 + 0.5) / 100


def stage_key(x: Column, low: float = -2.0, high: float = 14.0) -> Column:
    return F.format_string("%.2f", F.floor((F.least(F.lit(high), F.greatest(F.lit(low), x)) + 1e-9) * 20) / 20)


def clamped(x: Column, low: float = -2.0, high: float = 14.0) -> Column:
    return (x < low) | (x > high)


def stage_code(stage_c: Column) -> Column:
    """``p0390`` for 390 hundredths, ``m0050`` for -50."""
    return F.concat(F.when(stage_c < 0, "m").otherwise("p"), F.format_string("%04d", F.abs(stage_c).cast("int")))


def vertical_penalty(stage: Column) -> Column:
    p = (stage - C.PENALTY_FROM_FT) / (C.PENALTY_TO_FT - C.PENALTY_FROM_FT)
    floor = math.exp(-C.PENALTY_POWER)
    middle = C.PENALTY_FT * (F.exp(-C.PENALTY_POWER * p) - floor) / (1 - floor)
    return F.when(stage <= C.PENALTY_FROM_FT, F.lit(C.PENALTY_FT)).when(stage >= C.PENALTY_TO_FT, F.lit(0.0)).otherwise(middle)


def penalized_depth(stage: Column, ground: Column) -> Column:
    raw = F.greatest(F.lit(0.0), stage - ground)
    return raw - F.least(vertical_penalty(stage), (1 - C.RETAINED) * raw)


def depth_code(depth: Column, breaks: list[float] = C.DEPTH_BREAKS_FT) -> Column:
    """1 below the first break, one more from each break on."""
    return sum(((depth >= b).cast("int") for b in breaks), F.lit(1))


def activation_code(ground: Column, connection: Column) -> Column:
    at = F.greatest(ground, connection)
    return F.when(at < C.FLOOD_FT["moderate"] - 1, 1).when(at < C.FLOOD_FT["moderate"], 2).otherwise(3)


def connection_bin(conn_d: Column) -> Column:
    return F.expr("cast(0 as int)") + ((F.least(F.lit(C.HIST_MAX_D), F.greatest(F.lit(C.HIST_MIN_D), conn_d)) - C.HIST_MIN_D) / 20).cast("int")


def packed(elev_d: Column, conn_d: Column) -> dict[str, Column]:
    """Four bytes: elevation high and low, connection, and 255."""
    raised = elev_d.cast("int") + 32768
    return {
        "r": F.shiftright(raised, 8).bitwiseAND(F.lit(255)),
        "g": raised.bitwiseAND(F.lit(255)),
        "b": F.when(conn_d.between(-100, 154), conn_d.cast("int") + 100).otherwise(255),
        "a": F.lit(255),
    }


def normalize_time(s: Column) -> Column:
    """``HH:MM`` of three or four digits, null where they name no time."""
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")
    four = F.when(F.length(digits) == 3, F.concat(F.lit("0"), digits)).when(F.length(digits) >= 4, F.substring(digits, 1, 4))
    return F.when(four.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.concat(F.substring(four, 1, 2), F.lit(":"), F.substring(four, 3, 2)))


def display_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def civil_midnight(day: Column, zone: str) -> Column:
    """The instant (epoch seconds) at which a civil day starts in ``zone``, whatever the session's zone."""
    return F.unix_timestamp(F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0), F.lit(zone)))


def civil_day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """UTC instants of a civil day's start and of the next one's."""
    return F.timestamp_seconds(civil_midnight(day, zone)), F.timestamp_seconds(civil_midnight(F.date_add(day, 1), zone))


def civil_day(t: Column, zone: str) -> Column:
    """The civil day of an instant (epoch seconds)."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=t)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def utc_stamp(t: Column) -> Column:
    """``2024-01-31T05:00:00Z`` of an instant (epoch seconds), whatever the session's zone."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=t)
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cm_to_ft(x: Column) -> Column:
    return x / 30.48


def inches_per_decade_to_ft_per_year(x: Column) -> Column:
    return x / 12 / 10


#: Colours of the stage codes 1 to 3, of the depth codes 1 to 11, and of green cells, whose codes follow; opacities of water and of green (fixed values).
STAGE_COLOURS = ["#F4A742", "#E74C3C", "#7D3C98"]
DEPTH_COLOURS = ["#7DF9FF", "#5DE7FF", "#38D3FF", "#1BB7F5", "#168CEB", "#156BE0", "#1853C6", "#173EA8", "#132F84", "#0B1E5B", "#050E33"]
GREEN_COLOUR = "#63D471"
WATER_ALPHA, GREEN_ALPHA = 225, 205


def colour(code: Column, colours: list[str] = STAGE_COLOURS) -> Column:
    """The colour of a code from 1 on, green for the code after the last; null for any other."""
    return F.get(F.array(*map(F.lit, [*colours, GREEN_COLOUR])), code - 1)


def opacity(code: Column, colours: list[str] = STAGE_COLOURS) -> Column:
    """0 (nothing drawn) for codes without a colour."""
    return F.when(code.between(1, len(colours)), WATER_ALPHA).when(code == len(colours) + 1, GREEN_ALPHA).otherwise(0)


def hex_rgb(s: Column) -> Column:
    body = F.regexp_replace(s, "^#", "")
    return F.array(*(F.conv(F.substring(body, k, 2), 16, 10).cast("int") for k in (1, 3, 5)))


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a stamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
