"""Scalar and array functions on signals and on text, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference pressure, and the floor that is added before taking the logarithm of a power.
REFERENCE_PRESSURE, POWER_FLOOR = 20e-6, 1e-12


def pascal_factor(full_scale_db: float) -> float:
    """Pascal of a sample of 1.0, if a sine of full scale has this level."""
    return math.sqrt(2) * REFERENCE_PRESSURE * 10 ** (full_scale_db / 20)


def to_pascal(x: Column, full_scale_db: float) -> Column:
    return F.transform(x, lambda v: v * F.lit(pascal_factor(full_scale_db)))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms(x: Column) -> Column:
    return F.sqrt(array_sum(F.transform(x, lambda v: v * v)) / F.size(x))


def spl(x: Column, full_scale_db: float) -> Column:
    """Level in dB: NaN for no samples, minus infinity for silence."""
    level = 20 * F.log10(rms(x) * F.lit(math.sqrt(2))) + full_scale_db
    return F.when(F.size(x) <= 0, F.lit(float("nan"))).when(rms(x) <= 0, F.lit(float("-inf"))).otherwise(level)


def power_db(power: Column) -> Column:
    return 10 * F.log10(power + F.lit(POWER_FLOOR))


def format_number(value: Column, precision: int = 6) -> Column:
    """Text of a cell: empty for null, nan, inf and -inf as such, else rounded half to even."""
    text = F.bround(value, precision).cast("string")
    return F.when(value.isNull(), "").when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(text)


def format_time(seconds: Column) -> Column:
    """m:ss of non-negative seconds."""
    whole = F.bround(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def format_value(value: Column) -> Column:
    """Fewer decimals for larger values, three significant digits below one, a dash for none."""
    size = F.abs(value)
    small = F.format_string("%.3g", value)
    return (
        F.when(value.isNull() | F.isnan(value), "–").when(value == 0, "0").when(size >= 1000, F.format_string("%.0f", value))
        .when(size >= 10, F.format_string("%.1f", value)).when(size >= 1, F.format_string("%.2f", value)).otherwise(small)
    )


def short_name(name: Column) -> Column:
    """A dotted name without its family, if more than two parts."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), ".")).otherwise(name)


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def lua_string(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def channel(colour: Column, which: int) -> Column:
    """Red (0), green (1) or blue (2) of #RRGGBB, 128 for anything else."""
    part = F.conv(F.substring(colour, 2 + 2 * which, 2), 16, 10).cast("int")
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), part).otherwise(128)


def luminance(colour: Column) -> Column:
    total = F.lit(0.0)
    for which, share in enumerate((0.2126, 0.7152, 0.0722)):
        c = channel(colour, which) / 255.0
        total = total + share * F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return total


def ink(colour: Column, dark: str = "#000000", light: str = "#ffffff") -> Column:
    """Of two inks the one of higher contrast on a colour."""
    ratio = lambda a, b: (F.greatest(luminance(a), luminance(b)) + 0.05) / (F.least(luminance(a), luminance(b)) + 0.05)
    return F.when(ratio(colour, F.lit(dark)) >= ratio(colour, F.lit(light)), dark).otherwise(light)
