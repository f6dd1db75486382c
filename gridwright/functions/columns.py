"""Scalar column rules: units, coordinates, names, gates, blends, seeds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def as_null(value: Column) -> Column:
    """NaN means "no path" in files; inside DataFrames it is NULL."""
    return F.when(~F.isnan(value), value)


def unit_scale(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    return (
        F.when(u.isin("m", "meter", "metre"), F.lit(1.0)).when(u == "cm", F.lit(0.01)).when(u == "mm", F.lit(0.001))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported unit: "), F.coalesce(unit, F.lit("<null>")))).cast("double"))
    )


def to_metres(df: DataFrame, unit: Column, cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return df.withColumns({c: F.col(c) * unit_scale(unit) for c in cols})


def affine_align(df: DataFrame, angle_deg: float, scale: float, tx: float, ty: float, mirror_y: float = 100.0) -> DataFrame:
    """Undo a mirrored similarity: mirror to east/north, shift, rotate back, unscale."""
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    east, north = -F.col("x") - tx, F.lit(float(mirror_y)) - F.col("y") - ty
    return df.withColumns({
        "ax": (east * c + north * s) / scale,
        "ay": (north * c - east * s) / scale,
    })


def plan_to_grid(x: Column, y: Column, rotation_deg: Column, scale: Column, dcol: Column, drow: Column,
                 rows: int, cols: int) -> tuple[Column, Column]:
    """(column, row) of plan-local metres under a similarity about the raster centre; row 0 is north."""
    angle = F.radians(rotation_deg)
    gx = scale * (F.cos(angle) * x - F.sin(angle) * y)
    gy = scale * (F.sin(angle) * x + F.cos(angle) * y)
    return F.lit((cols - 1) / 2.0) + dcol + gx, F.lit((rows - 1) / 2.0) + drow - gy


def grid_to_world(col: Column, row: Column, min_x: Column, max_y: Column, res: float) -> tuple[Column, Column]:
    return min_x + (col + 0.5) * res, max_y - (row + 0.5) * res


def cell_index(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("bigint")


# Keyword -> category, first hit wins.
NAME_CATEGORIES = (
    ("glass", "glass"), ("curtain", "glass"), ("water", "water"), ("asphalt", "asphalt"), ("road", "asphalt"),
    ("vegetation", "vegetation"), ("grass", "vegetation"), ("limestone", "limestone"), ("stone", "stone"),
    ("concrete", "concrete"), ("metal", "metal_roof"), ("roof", "roof"), ("soil", "soil"),
    ("terrain", "ground"), ("ground", "ground"),
)
# Words that mark ground objects.
GROUND_WORDS = ("ground", "terrain", "road", "asphalt", "water", "vegetation")


def category_from_name(name: Column) -> Column:
    def rule_of(plain: Column) -> Column:
        rule = None
        for word, category in NAME_CATEGORIES:
            test = plain.contains(word)
            rule = F.when(test, category) if rule is None else rule.when(test, category)
        return rule

    # the plain name is made once, not once a word
    return F.get(F.transform(F.array(F.translate(F.lower(name), "- ", "__")), rule_of), F.lit(0))


def is_ground_name(name: Column) -> Column:
    plain = F.lower(name)
    hit = F.lit(False)
    for word in GROUND_WORDS:
        hit = hit | plain.contains(word)
    return hit


def bounded_pair(low: Column, high: Column) -> Column:
    """STRUCT<lo,hi>, NULL when absent, an error when half given, negative or reversed."""
    bad = low.isNull() | high.isNull() | (low < 0) | (high < low)
    return F.when(low.isNull() & high.isNull(), None).when(
        bad, F.raise_error(F.lit("invalid bounded range")).cast("struct<lo:double,hi:double>")
    ).otherwise(F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi")))


def normalize_bool(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return (
        F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)
        .otherwise(F.raise_error(F.concat(F.lit("invalid boolean value: "), F.coalesce(text, F.lit("<null>")))).cast("boolean"))
    )


# Fourier wavelengths in metres.
WAVELENGTHS_M = (25.0, 75.0, 200.0)


def fourier_features(x: Column, y: Column, wavelengths: Sequence[float] = WAVELENGTHS_M) -> dict[str, Column]:
    out = {"fx": x / 100.0, "fy": y / 100.0}
    for w in wavelengths:
        k = 2.0 * math.pi / w
        for name, v in (("x", x), ("y", y)):
            out[f"sin_{name}_{int(w)}"] = F.sin(v * k)
            out[f"cos_{name}_{int(w)}"] = F.cos(v * k)
    return out


def path_power_db(power: Column) -> Column:
    return F.when(power > 0, 10.0 * F.log10(power))


def blend(a: Column, b: Column, weight: Column) -> Column:
    """weight·a + (1-weight)·b with the weight clipped to [0, 1]."""
    w = clip(weight, 0.0, 1.0)
    return w * a + (1.0 - w) * b


def blend_pair(fixed: Column, other: Column, other_probability: Column) -> Column:
    """As :func:`blend`, falling back to the side that exists."""
    return F.coalesce(blend(other, fixed, other_probability), fixed, other)


def distance_gate(d: Column, scale: float | Column) -> Column:
    r = F.greatest(d, F.lit(0.0)) / scale
    return F.exp(-0.5 * r * r)


def inverse_risk_gate(risk_a: Column, risk_b: Column, power: float | Column) -> Column:
    a, b = (F.pow(F.greatest(r, F.lit(0.1)), power) for r in (risk_a, risk_b))
    return b / F.greatest(a + b, F.lit(1e-12))


def shrink_by_distance(d: Column, length_m: float = 50.0) -> Column:
    return F.exp(-d / length_m)


def hash_u32(text: Column) -> Column:
    """First 32 bits of the SHA-256 digest as a BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def derive_seed(base: Column | int, *labels: Column | str | int) -> Column:
    parts = [c if isinstance(c, Column) else F.lit(str(c)) for c in (base, *labels)]
    return hash_u32(F.concat_ws("|", *[p.cast("string") for p in parts]))


def reasons(*tests: tuple[Column, str]) -> Column:
    """Ordered list of the reason codes whose test is true."""
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda r: r.isNotNull())


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
