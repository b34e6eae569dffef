"""Column helpers: blanks, guarded overwrites, rounding, exact sums, code maps, indices and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def overwrite(ok: Column, new: Column, old: Column) -> Column:
    """The new value wherever the source is sound."""
    return F.when(ok, new).otherwise(old)


def complement(ok: Column, new: Column, old: Column) -> Column:
    """The new value only where the source is sound and the old one is blank."""
    return F.when(ok & blank(old), new).otherwise(old)


def pair_key(paired_with: Column, site: Column) -> Column:
    """What a treated row and its controls share."""
    return F.coalesce(F.nullif(paired_with, F.lit("")), site)


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of rows; 0 for no values."""
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0).cast(MONEY)).cast("double")


def exact_avg(c: Column) -> Column:
    """A mean that does not depend on the order of rows; null for no values."""
    return F.try_divide(F.sum(c.cast(MONEY)).cast("double"), F.count(c).cast("double"))


def half_up(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def scaled_short(c: Column, scale: float = 10000.0, nodata: int = -9999) -> Column:
    """Half-even scaling to 16 bits; null becomes the nodata code."""
    return F.coalesce(F.bround(c * F.lit(scale)), F.lit(float(nodata))).cast("short")


def fold(c: Column) -> Column:
    """Lower case without accents; what is not ASCII after that is left out."""
    with_marks, without = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    return F.lower(F.regexp_replace(F.translate(c, with_marks, without), "[^\\x00-\\x7F]", ""))


def mapped(c: Column, table: dict, default: Column | None = None) -> Column:
    """A small code table; codes that it lacks give the default, or stay as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c if default is None else default)


def bits_clear(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask)) == 0


def safe_ratio(num: Column, den: Column, least: float = 1e-6, low: float = -1.0, high: float = 1.0) -> Column:
    """num / den within limits; null where the denominator is too small."""
    return F.when(F.abs(den) >= least, F.greatest(F.lit(low), F.least(F.lit(high), num / den)))


def phase(h: Column) -> Column:
    return F.when(h < 0, "pre").when(h <= 1, "durante").otherwise("pos")


def pair_quality(l1: Column) -> Column:
    return F.when(l1 <= 0.10, "bom").when(l1 <= 0.20, "aceitavel").otherwise("ruim")


def rgb(hex_color: Column) -> Column:
    """Red, green and blue of #rrggbb."""
    return F.array(*[F.conv(F.substring(hex_color, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])
