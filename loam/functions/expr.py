"""Scalar expressions: Column -> Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dict_map(c: Column, mapping: Mapping[str, str], keep_unknown: bool = False) -> Column:
    """Mapped value; unknown values become NULL, or stay with ``keep_unknown``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], c) if keep_unknown else m[c]


def not_in_keep_null(c: Column, values: Sequence[object]) -> Column:
    """True for values outside the list and for NULL."""
    return F.coalesce(~c.isin(*values), F.lit(True))


def null_or_at_most(c: Column, limit: float) -> Column:
    return c.isNull() | (c <= limit)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL."""
    out = c if low is None else F.when(c.isNotNull(), F.greatest(c, F.lit(low)))
    return out if high is None else F.when(c.isNotNull(), F.least(out, F.lit(high)))


def round_even(c: Column, digits: int) -> Column:
    """Rounded half to even on the scaled double, as array libraries do it."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def number(c: Column) -> Column:
    """Text to double, NULL where it is no number."""
    return c.try_cast("double")


def mod360(angle: Column) -> Column:
    """Angle in [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def azimuth(dx: Column, dy: Column) -> Column:
    """Compass direction in degrees of a step east ``dx`` and north ``dy``."""
    return mod360(F.degrees(F.atan2(dx, dy)))


def downwind(direction: Column) -> Column:
    """Where a wind from ``direction`` blows to."""
    return mod360(direction + 180)


def angle_between(a: Column, b: Column) -> Column:
    """Signed difference a - b of two directions in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def decay(distance: Column, scale: float) -> Column:
    return F.exp(-distance / scale)


def saturation(count: Column, scale: float = 3.0) -> Column:
    return 1 - F.exp(-count / scale)


def compactness(area: Column, perimeter: Column) -> Column:
    """4 pi area / perimeter squared; NULL without a perimeter."""
    return 4 * F.pi() * area / F.nullif(perimeter * perimeter, F.lit(0.0))


def growth(new: Column, old: Column) -> Column:
    """Relative growth; NULL where old is 0 or NULL."""
    return (new - old) / F.nullif(old.cast("double"), F.lit(0.0))


def log_ratio(new: Column, old: Column) -> Column:
    return F.log((new + 1) / (old + 1))


def season(month: Column) -> Column:
    """Season of a month number; NULL stays NULL."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn")


def degree_days(low: Column, high: Column, base: float, cap: float) -> Column:
    """Mean of the daily extremes, cut at ``cap``, above ``base``."""
    return F.greatest(F.least((low + high) / 2, F.lit(cap)) - base, F.lit(0.0))


def pair_mean_std(a: Column, b: Column) -> tuple[Column, Column]:
    """Mean and sample standard deviation across two columns."""
    return (a + b) / 2, F.abs(a - b) / F.sqrt(F.lit(2.0))


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", c)


def order_hash(seed: int, *keys: Column) -> Column:
    """Reproducible random order of rows, the same in every engine: md5 of the keys and a seed."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def hash_unit(seed: int, *keys: Column) -> Column:
    """Reproducible uniform number in (0, 1) from the keys."""
    return (F.conv(F.substring(order_hash(seed, *keys), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
