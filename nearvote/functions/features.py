"""The vectoriser, dates and fixed-point conversion as column expressions (all inside whole-stage codegen).

Single-precision steps are kept: Spark divides floats as doubles, so each such division is cast back, which rounds
correctly.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def div32(a: Column, b: float) -> Column:
    return f32(f32(a) / f32(b))


def clamp01(x: Column) -> Column:
    """NaN passes."""
    return F.when(x < 0, f32(0.0)).when((x > 1) & ~F.isnan(x), f32(1.0)).otherwise(x)


def ratio(n: Column, d: Column, most: float) -> Column:
    return F.when(d <= 0, F.when(n > 0, f32(1.0)).otherwise(f32(0.0))).otherwise(clamp01(f32(n / d / F.lit(most))))


def mcc_risk(code: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in S.MCC_RISK.items()))
    return f32(F.coalesce(F.element_at(table, code), F.lit(S.MCC_DEFAULT)))


def is_known(known: Column, merchant: Column) -> Column:
    """Exact membership among the first known merchants."""
    return F.coalesce(F.array_contains(F.slice(known, 1, S.MOST_KNOWN), merchant), F.lit(False))


def vector(amount: Column, installments: Column, customer_avg: Column, hour: Column, weekday: Column, delta_s: Column, last_km: Column, has_last: Column, home_km: Column, count_24h: Column, online: Column, present: Column, known: Column, mcc: Column, merchant_avg: Column) -> list[Column]:
    """The 14 features, in order. Without a last transaction dimensions 5 and 6 are -1."""
    none = f32(-1.0)
    bit = lambda c: F.when(c, f32(1.0)).otherwise(f32(0.0))
    minutes = f32(div32(delta_s, 60) / f32(S.MINUTES_MAX))
    out = [
        clamp01(f32(amount / F.lit(S.AMOUNT_MAX))),
        clamp01(div32(installments, S.INSTALLMENTS_MAX)),
        ratio(amount, customer_avg, S.RATIO_MAX),
        div32(hour, 23),
        div32(weekday, 6),
        F.when(has_last, clamp01(minutes)).otherwise(none),
        F.when(has_last, clamp01(f32(last_km / F.lit(S.KM_MAX)))).otherwise(none),
        clamp01(f32(home_km / F.lit(S.KM_MAX))),
        clamp01(div32(count_24h, S.COUNT_MAX)),
        bit(online),
        bit(present),
        bit(~known),
        mcc_risk(mcc),
        clamp01(f32(merchant_avg / F.lit(S.AMOUNT_MAX))),
    ]
    return [c.alias(n) for c, n in zip(out, S.V)]


def quantize(v: Column) -> Column:
    """Clamp to ±1, scale, round half away from zero in single precision, cut to a short. ``v`` stands here twice only:
    Spark repeats an expression wherever it is used, and the JVM doesn't compile a method of more than 8,000 bytes."""
    half = F.when(v < 0, f32(-0.5)).otherwise(f32(0.5))
    return (F.greatest(F.least(v, f32(1.0)), f32(-1.0)) * f32(float(S.SCALE)) + half).cast("short")


def dequantize(q: Column) -> Column:
    return div32(q, S.SCALE)


def bin_clamped(v: Column, bins: int) -> Column:
    return F.least(F.floor(clamp01(f32(v)) * f32(float(bins))), F.lit(bins - 1)).cast("int")


def sqdiff(a: Column, b: Column) -> Column:
    d = a.cast("int") - b.cast("int")
    return d.cast("long") * d.cast("long")


def _digits(text: Column, at: int, n: int) -> Column:
    return F.substring(text, at, n).cast("int")


def timestamp_ok(text: Column) -> Column:
    """At least 20 characters with digits and separators in place; what follows the seconds is ignored."""
    return F.coalesce((F.length(text) >= 20) & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"), F.lit(False))


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the proleptic Gregorian calendar. Months and days outside their range run on:
    whole months are added to the epoch, then days."""
    epoch = F.lit("1970-01-01").cast("date")
    return (F.datediff(F.add_months(epoch, (y - 1970) * 12 + m - 1), epoch) + d - 1).cast("long")


def parse_iso(text: Column) -> Column:
    """struct(epoch_s, hour, weekday with Monday 0), or null."""
    days = day_number(_digits(text, 1, 4), _digits(text, 6, 2), _digits(text, 9, 2))
    hour = _digits(text, 12, 2)
    epoch = days * 86400 + hour * 3600 + _digits(text, 15, 2) * 60 + _digits(text, 18, 2)
    return F.when(timestamp_ok(text), F.struct(epoch.alias("epoch_s"), hour.alias("hour"), F.pmod(days + 3, F.lit(7)).cast("int").alias("weekday")))
