"""Column-expression helpers shared by the reports (all JVM-side built-ins).

Rounding: the reports round ``numeric`` values half away from zero.  Engines
disagree on ties for doubles, so every rounded value is computed from exact
integers: the numerator in hundredths of the result unit and an integer
denominator, then ``(2|n| + |d|) div 2|d|`` with the sign restored.
``sql_*`` twins render the same arithmetic for the DuckDB oracle.
"""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
# hundredths of an hour per microsecond: hours*100 = micros / 36e6
MICROS_PER_HUNDREDTH_HOUR = 36_000_000
MICROS_PER_DAY = 86_400_000_000
BIG = "decimal(38,0)"


def idiv(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero (SQL ``div``)."""
    return F.call_function("div", a, b)


def round_half_away(num: Column, den: Column) -> Column:
    """``num/den`` rounded half away from zero to an integer; NULL if den is 0/NULL."""
    d = F.nullif(den, F.lit(0))
    q = idiv(F.abs(num) * 2 + F.abs(d), F.abs(d) * 2)
    return F.when((num < 0) != (d < 0), -q).otherwise(q)


def hundredths(h: Column) -> Column:
    return h.cast("double") / F.lit(100.0)


def round2(num_hundredths: Column, den: Column) -> Column:
    """ROUND(x, 2) of x = num_hundredths / (100 * den), exactly, as DOUBLE."""
    return hundredths(round_half_away(num_hundredths, den))


def cents(money: Column) -> Column:
    """decimal(18,2) money -> exact integer cents (LongType)."""
    return (money * 100).cast("long")


def money_from_cents(c: Column) -> Column:
    """Exact money, decimal(38,2), from integer cents."""
    return (c.cast("decimal(36,0)") * F.lit(decimal.Decimal("0.01"))).cast("decimal(38,2)")


def pct(a: Column, b: Column) -> Column:
    """ROUND(a::numeric / NULLIF(b, 0) * 100, 2) for integral a, b."""
    return round2(a.cast(BIG) * 10000, b)


def micros_between(start: Column, end: Column) -> Column:
    """EXTRACT(EPOCH FROM end - start) in integer microseconds."""
    return F.timestamp_diff("MICROSECOND", start, end)


def avg_hours2(sum_micros: Column, n: Column) -> Column:
    """ROUND(AVG(epoch/3600), 2) from an exact microsecond sum and count."""
    return round2(sum_micros.cast(BIG), n.cast(BIG) * MICROS_PER_HUNDREDTH_HOUR)


def whole_days_between(start: Column, end_date: dt.date) -> Column:
    """EXTRACT(DAYS FROM (date - ts)): whole days, truncated toward zero."""
    return idiv(micros_between(start, ts_lit(end_date)), F.lit(MICROS_PER_DAY))


def ts_lit(d: dt.date | dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal at midnight of ``d`` (or at ``d`` itself)."""
    if not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return F.lit(d).cast("timestamp_ntz")


def bucket(ts: Column, unit: str) -> Column:
    """DATE_TRUNC(unit, ts) kept as ``timestamp_ntz`` (week = ISO Monday)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def bucket_start(d: dt.date, unit: str) -> dt.datetime:
    if unit == "day":
        s = d
    elif unit == "week":
        s = d - dt.timedelta(days=d.weekday())
    elif unit == "month":
        s = d.replace(day=1)
    else:
        raise ValueError(unit)
    return dt.datetime(s.year, s.month, s.day)


def bucket_end(d: dt.date, unit: str) -> dt.datetime:
    s = bucket_start(d, unit)
    if unit == "day":
        return s + dt.timedelta(days=1)
    if unit == "week":
        return s + dt.timedelta(days=7)
    return dt.datetime(s.year + (s.month // 12), s.month % 12 + 1, 1)


def in_bucket(ts: Column, unit: str, as_of: dt.date) -> Column:
    """DATE_TRUNC(unit, ts) = DATE_TRUNC(unit, as_of) as a half-open range.

    The range form reaches the Parquet scan as ``GreaterThanOrEqual``/
    ``LessThan`` pushed filters (row-group pruning); ``date_trunc(ts) = c``
    would not be pushed.
    """
    return (ts >= ts_lit(bucket_start(as_of, unit))) & (ts < ts_lit(bucket_end(as_of, unit)))


def since(ts: Column, as_of: dt.date, days: int = 0, months: int = 0) -> Column:
    """ts >= as_of - INTERVAL (days|months); no upper bound, as in the reports."""
    return ts >= ts_lit(minus(as_of, days=days, months=months))


def minus(as_of: dt.date, days: int = 0, months: int = 0) -> dt.datetime:
    d = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=days)
    if months:
        m = d.year * 12 + d.month - 1 - months
        y, mo = divmod(m, 12)
        import calendar
        day = min(d.day, calendar.monthrange(y, mo + 1)[1])
        d = d.replace(year=y, month=mo + 1, day=day)
    return d


def dow0(ts: Column) -> Column:
    """EXTRACT(DOW): Sunday = 0 .. Saturday = 6."""
    return F.dayofweek(ts) - 1


def lsn_to_long(lsn: Column) -> Column:
    """'HI/LO' hex log position -> byte offset (HI * 2^32 + LO) as DECIMAL(38,0)."""
    hi = F.conv(F.split_part(lsn, F.lit("/"), F.lit(1)), 16, 10).cast(BIG)
    lo = F.conv(F.split_part(lsn, F.lit("/"), F.lit(2)), 16, 10).cast(BIG)
    return hi * F.lit(4294967296).cast(BIG) + lo


def size_pretty(nbytes: Column) -> Column:
    """Human readable byte count in the server's style: below 10 kB in bytes,
    then kB, MB, GB, TB in 1024 steps, each rounded half up from one extra
    binary digit (shift by 9, 10, 10, 10 bits; value (x + 1) div 2)."""
    b = nbytes.cast("long")
    out = F.when(F.abs(b) < 10 * 1024, F.concat(b.cast("string"), F.lit(" bytes")))
    x = F.shiftright(b, 9)
    for unit in ["kB", "MB", "GB"]:
        half = idiv(x + F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)), F.lit(2))
        out = out.when(F.abs(x) < 20 * 1024 - 1, F.concat(half.cast("string"), F.lit(" " + unit)))
        x = F.shiftright(x, 10)
    half = idiv(x + F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)), F.lit(2))
    return out.otherwise(F.concat(half.cast("string"), F.lit(" TB")))


def sql_size_pretty(nbytes: str) -> str:
    b = f"CAST({nbytes} AS BIGINT)"
    parts = [f"WHEN abs({b}) < 10240 THEN CAST({b} AS VARCHAR) || ' bytes'"]
    shift = 9
    for unit in ["kB", "MB", "GB"]:
        x = f"({b} >> {shift})"
        parts.append(f"WHEN abs({x}) < 20479 THEN CAST((({x}) + CASE WHEN {x} < 0 THEN -1 ELSE 1 END) // 2 AS VARCHAR)"
                     f" || ' {unit}'")
        shift += 10
    x = f"({b} >> {shift})"
    return (f"(CASE {' '.join(parts)} ELSE CAST((({x}) + CASE WHEN {x} < 0 THEN -1 ELSE 1 END) // 2 AS VARCHAR)"
            f" || ' TB' END)")


# ---------------------------------------------------------------------------
# SQL twins (DuckDB dialect) for oracle strings
# ---------------------------------------------------------------------------

def sql_round_half_away(num: str, den: str) -> str:
    return (f"(CASE WHEN ({den}) = 0 THEN NULL "
            f"WHEN (({num}) < 0) <> (({den}) < 0) THEN -((2*abs({num}) + abs({den})) // (2*abs({den}))) "
            f"ELSE (2*abs({num}) + abs({den})) // (2*abs({den})) END)")


def sql_round2(num_h: str, den: str) -> str:
    return f"(CAST({sql_round_half_away(num_h, den)} AS DOUBLE) / 100)"


def sql_hours_h(start: str, end: str) -> str:
    """Integer hundredths of ROUND(AVG(epoch(end - start)/3600), 2)."""
    m = sql_micros(start, end)
    return sql_round_half_away(f"SUM(CAST({m} AS HUGEINT))", f"COUNT({m}) * {MICROS_PER_HUNDREDTH_HOUR}")


def sql_pct(a: str, b: str) -> str:
    return sql_round2(f"CAST({a} AS HUGEINT) * 10000", b)


def sql_cents(money: str) -> str:
    return f"CAST(({money}) * 100 AS BIGINT)"


def sql_avg2_money(money: str) -> str:
    return sql_round2(f"SUM({sql_cents(money)})", f"COUNT({money})")


def sql_micros(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start}))"


def sql_avg_hours2(start: str, end: str) -> str:
    m = sql_micros(start, end)
    return sql_round2(f"SUM(CAST({m} AS HUGEINT))", f"COUNT({m}) * {MICROS_PER_HUNDREDTH_HOUR}")


def sql_ts(d: dt.date | dt.datetime) -> str:
    if not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return f"TIMESTAMP '{d:%Y-%m-%d %H:%M:%S}'"


def sql_days(start: str, as_of: dt.date) -> str:
    m = f"(epoch_us({sql_ts(as_of)}) - epoch_us({start}))"
    return f"CAST(({m}) // {MICROS_PER_DAY} AS BIGINT)"
