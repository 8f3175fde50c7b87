"""Scalar expressions over measured-source columns; all of them run inside Spark's code generation.

NaN and NULL both mean "not measured". Spark orders NaN above every number, so each comparison is
guarded by :func:`finite`.
"""

from __future__ import annotations

import functools
import math
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
PIXEL_SCALE = 0.168


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def coalesce_finite(df: DataFrame, names: list[str]) -> Column:
    """Per row the first finite value among those of ``names`` that the table has; NaN if none."""
    return F.coalesce(*[F.when(finite(n), F.col(n).cast("double")) for n in present(df, names)], F.lit(NAN))


def first_usable_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of ``names`` with any finite value in the whole table, found in one aggregation."""
    names = present(df, names)
    if not names:
        return None
    seen = df.agg(*[F.max(finite(n)).alias(n) for n in names]).first()
    return next((n for n in names if seen[n]), None)


def flux_to_mag(flux: str | Column, zero_point: float = 27.0) -> Column:
    """zero_point - 2.5 log10(flux) for a finite positive flux, else NaN."""
    flux = col(flux)
    return F.when(finite(flux) & (flux > 0), zero_point - 2.5 * F.log10(flux)).otherwise(NAN)


def recalibrate_mag(df: DataFrame, triples: list[tuple[str, str, str]], zero_point: float) -> DataFrame:
    """Rewrite (njy, magnitude) from stored fluxes for a new zero point; triples are (flux, njy, mag)."""
    scale = 10 ** ((31.4 - zero_point) / 2.5)
    new = {}
    for flux, njy, mag in triples:
        new[njy] = F.when(finite(flux), F.col(flux) * scale).otherwise(NAN)
        new[mag] = flux_to_mag(flux, zero_point)
    return df.withColumns(new)


def moments_to_ellipse(xx: Column, yy: Column, xy: Column, floor: float | None = 0.25) -> tuple[Column, Column, Column]:
    """(major, minor, theta) from second moments.

    With a floor, variances and eigenvalues are at least ``floor``. Without one both eigenvalues must be
    positive, else all is NaN.
    """
    good = finite(xx) & finite(yy) & finite(xy)
    if floor is not None:
        xx, yy = F.greatest(xx, F.lit(floor)), F.greatest(yy, F.lit(floor))
    spread = F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy)
    large, small = 0.5 * (xx + yy + spread), 0.5 * (xx + yy - spread)
    if floor is not None:
        large, small = F.greatest(large, F.lit(floor)), F.greatest(small, F.lit(floor))
    else:
        good = good & (large > 0) & (small > 0)
    theta = 0.5 * F.atan2(2.0 * xy, xx - yy)
    return tuple(F.when(good, v).otherwise(NAN) for v in (F.sqrt(large), F.sqrt(small), theta))


def kron_ellipse(major: Column, minor: Column, theta: Column, radius: Column, sigma: float = 1.0, min_axis: float = 1.0, matched: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """(a, b, angle, area): axes scaled to the Kron radius, times sigma, floored; NaN without a valid radius."""
    size = F.sqrt(F.greatest(major * minor, F.lit(0.0)))
    good = finite(radius) & (radius > 0) & finite(major) & finite(minor) & finite(theta) & (size > 0)
    if matched is not None:
        good = good & F.coalesce(matched, F.lit(False))
    a, b = (F.greatest(axis * (radius / size) * sigma, F.lit(min_axis)) for axis in (major, minor))
    return tuple(F.when(good, v).otherwise(NAN) for v in (a, b, theta, math.pi * a * b))


def axis_ratio(a: Column, b: Column) -> Column:
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return F.when(finite(a) & finite(b) & (low > 0), high / low).otherwise(NAN)


def snr(flux: Column, error: Column) -> Column:
    return F.when(finite(flux) & finite(error) & (error > 0), flux / error).otherwise(NAN)


def fill_ratio(pixels: Column, area: Column) -> Column:
    return F.when(finite(pixels) & finite(area) & (area > 0), pixels / area).otherwise(NAN)


def _capped_snr(base: Column, t: Column, cap: float) -> tuple[Column, Column]:
    if cap > 0:
        t = F.when(finite(t), F.least(t, F.lit(cap))).otherwise(NAN)
    return F.when(finite(base) & (base > 0) & finite(t) & (t >= 0), base * F.sqrt(t)).otherwise(NAN), t


def snr_from_variance(base: Column, coadd: Column, image: Column, scale: float = 1.0, cap: float = 1.0) -> tuple[Column, Column]:
    """(snr, T) predicted for an image by its variance against the coadd's."""
    good = finite(base) & (base > 0) & finite(coadd) & (coadd > 0) & finite(image) & (image > 0)
    return _capped_snr(base, F.when(good, coadd * scale * scale / image).otherwise(NAN), cap)


def snr_from_weight_ratio(base: Column, coadd_sum: Column, chosen_sum: Column, chosen_count: Column, local: Column, reference: Column | None = None, reference_count: Column | None = None, cap: float = 1.0) -> tuple[Column, Column]:
    """(snr, T) predicted by weight sums and local coverage, optionally over the reference's coverage."""
    cover = local / chosen_count
    good = finite(coadd_sum) & (coadd_sum > 0) & finite(chosen_sum) & (chosen_sum > 0) & finite(chosen_count) & (chosen_count > 0) & finite(cover) & (cover > 0)
    t = chosen_sum / coadd_sum * F.least(cover, F.lit(1.0))
    if reference is not None:
        whole = reference / reference_count
        good = good & finite(whole) & (whole > 0)
        t = t / F.least(whole, F.lit(1.0))
    return _capped_snr(base, F.when(good, t).otherwise(NAN), cap)


def unpack_flag(df: DataFrame, name: str, bits: dict[str, int], packed: str = "flags", strict: bool = False) -> Column:
    """A named flag: its boolean column, else its bit of the packed vector, else False (an error if strict)."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    if packed in df.columns and name in bits:
        return F.coalesce(F.get(F.col(packed), bits[name]), F.lit(False))
    if strict:
        raise KeyError(f"no flag {name}")
    return F.lit(False)


def mask_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def mask_hits(mask: Column, planes: dict[str, int]) -> Column:
    """Names of the planes whose bit is set, joined by ``;``."""
    return F.concat_ws(";", *[F.when(mask_bit(mask, b), F.lit(n)) for n, b in planes.items()])


def bad_score(mask: Column, planes: dict[str, int], weights: dict[str, float], ignored: Column | None = None) -> Column:
    """The largest weight over a pixel's active planes; ``ignored`` switches the plane BAD off."""
    parts = [F.lit(0.0)]
    for name, weight in weights.items():
        if name in planes and weight > 0:
            on = mask_bit(mask, planes[name])
            if name == "BAD" and ignored is not None:
                on = on & ~ignored
            parts.append(F.when(on, weight).otherwise(0.0))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def score_category(score: Column) -> Column:
    return F.when(score >= 0.5, "gt_50").when(score >= 0.2, "20_50").when(score >= 0.1, "10_20").when(score >= 0.05, "5_10").otherwise("lt_5")


def area_equivalent(area: Column, scale: float) -> Column:
    return area * (scale / PIXEL_SCALE) ** 2


def exceeds(value: Column, limit: float) -> Column:
    """Above ``limit`` by more than rounding: a boundary moved by a few units in the last place is not."""
    return finite(value) & (value >= 0) & (value > limit) & (F.abs(value - limit) > 1e-14 * abs(limit))


def star_evidence(df: DataFrame, absolute_motion: bool = True) -> Column:
    """Parallax or proper motion at three sigma, or motion of three and more; missing is no evidence."""
    c = lambda n: F.col(n).cast("double") if n in df.columns else F.lit(NAN)
    hyp = lambda a, b: F.sqrt(a * a + b * b)
    at_least = lambda v: finite(v) & (v >= 3)
    motion = hyp(snr(c("pmra"), c("pmra_error")), snr(c("pmdec"), c("pmdec_error")))
    found = at_least(snr(c("parallax"), c("parallax_error"))) | at_least(motion)
    return found | at_least(hyp(c("pmra"), c("pmdec"))) if absolute_motion else found


def extendedness_class(value: Column, cut: float = 0.5) -> Column:
    return F.when(~finite(value), "unknown").when(value < cut, "star").otherwise("galaxy")


def angle_delta(a: Column, b: Column) -> Column:
    """Difference of position angles, which repeat after pi."""
    return F.abs(F.pmod(a - b + math.pi / 2, F.lit(math.pi)) - math.pi / 2)


def smooth_l1(v: Column) -> Column:
    v = F.abs(v)
    return F.when(v < 1, 0.5 * v * v).otherwise(v - 0.5)


def shape_distance(area1: Column, a1: Column, b1: Column, t1: Column, area2: Column, a2: Column, b2: Column, t2: Column, weight: float = 1.0) -> Column:
    log = lambda v: F.ln(F.greatest(v, F.lit(1e-6)))
    weight = max(weight, 0.0)
    axes = smooth_l1(log(a1 / b1) - log(a2 / b2)) + smooth_l1(log(area1 / math.pi) - log(area2 / math.pi))
    return (2.0 * axes + weight * (1.0 - F.cos(2.0 * angle_delta(t1, t2)))) / (2.0 + weight)


def turned(theta: str | Column) -> Column:
    """The struct of cos and sin of an angle by the C library, whose last bit is right where that of the JVM may not be.

    For tables of sources, where the last bit tells whether a point on a rim is inside.
    """

    @F.arrow_udf("cos double, sin double")
    def both(angles: pa.Array) -> pa.Array:
        known = angles.dictionary_encode()
        values = known.dictionary.to_pylist()
        made = [pa.array([g(t) if math.isfinite(t) else math.nan for t in values], pa.float64()).take(known.indices) for g in (math.cos, math.sin)]
        return pa.StructArray.from_arrays(made, ["cos", "sin"])

    return both(col(theta).cast("double"))


def ellipse_form(px: Column, py: Column, x: Column, y: Column, a: Column, b: Column, theta: Column, turn: Column | None = None) -> Column:
    """The rotated quadratic form of a point about an ellipse: at most 1 inside. ``turn``: :func:`turned` of theta, where it is known."""
    dx, dy = px - x, py - y
    cos, sin = (F.cos(theta), F.sin(theta)) if turn is None else (turn["cos"], turn["sin"])
    u, v = cos * dx + sin * dy, -sin * dx + cos * dy
    u, v = u / F.greatest(a, F.lit(1e-6)), v / F.greatest(b, F.lit(1e-6))
    return u * u + v * v


def ellipse_contains(px, py, x, y, a, b, theta, turn=None) -> Column:
    return ellipse_form(px, py, x, y, a, b, theta, turn) <= 1.0


_TILE = r"^(?:group_(\d+)_)?(?:.*_)?r(\d+)_c(\d+)_x(-?\d+)_y(-?\d+)$"


def parse_tile_name(name: Column) -> dict[str, Column]:
    """group, row, col, x0, y0 of ``group_01_grid_r08_c01_x20268_y30844``, and the name without its group."""
    part = lambda i: F.nullif(F.regexp_extract(name, _TILE, i), F.lit("")).cast("int")
    return {"grp": part(1), "row": part(2), "col": part(3), "x0": part(4), "y0": part(5), "bare": F.regexp_replace(name, r"^group_\d+_", "")}


def parse_selector(text: Column) -> dict[str, Column]:
    """source, tract, patch and group of ``source:tract/patch@group``; digits become group_NN, # begins a comment."""
    bare = F.trim(F.regexp_replace(text, "#.*$", ""))
    group = F.nullif(F.regexp_extract(bare, "@(.*)$", 1), F.lit(""))
    head = F.regexp_replace(bare, "@.*$", "")
    place = F.regexp_replace(head, "^[^:]*:", "")
    none = lambda c: F.nullif(c, F.lit(""))
    return {
        "source": none(F.regexp_extract(head, "^([^:]*):", 1)),
        "tract": none(F.regexp_extract(place, "^([^/]*)/", 1)),
        "patch": none(F.regexp_extract(place, "/(.*)$", 1)),
        "grp": F.when(group.rlike(r"^\d+$"), F.concat(F.lit("group_"), F.when(F.length(group) < 2, F.lpad(group, 2, "0")).otherwise(group))).otherwise(group),
    }


def band_pattern(bands: Column, order: list[str]) -> Column:
    """Presence of each band in order, as 0 and 1."""
    return F.concat(*[F.when(F.array_contains(bands, b), "1").otherwise("0") for b in order])


def pattern_hole(pattern: Column) -> Column:
    return pattern.rlike("10+1")


def reason_string(reasons: Column) -> Column:
    """Distinct reasons in order, joined by ``;``; nulls are none."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(reasons))), ";")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def standardize_pixels(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``df`` with z: (value - mean) / population deviation of its plane; not finite is the mean; deviation 0 is 1."""
    clean = F.when(finite(value), F.col(value))
    over = Window.partitionBy(*keys)
    sd = F.stddev_pop(clean).over(over)
    return df.withColumn("z", (F.coalesce(clean, F.avg(clean).over(over)) - F.avg(clean).over(over)) / F.when(sd > 0, sd).otherwise(1.0))


def log_scale(df: DataFrame, value: str, keys: list[str], minimum: float = 0.0, high_pct: float = 99.0, a: float = 300.0) -> DataFrame:
    """``df`` with scaled: log1p(a x) / ln a of the value between ``minimum`` and a percentile; not finite is NaN."""
    clean = F.when(finite(value), F.col(value))
    tops = df.groupBy(*keys).agg(F.percentile(clean, high_pct / 100).alias("__hi"), F.max(clean).alias("__max"))
    hi = F.when(F.col("__hi") > minimum, F.col("__hi")).when(F.col("__max") > minimum, F.col("__max")).otherwise(minimum + 1.0)
    x = F.least(F.greatest((F.col(value) - minimum) / (hi - minimum), F.lit(0.0)), F.lit(1.0))
    return df.join(tops, keys).withColumn("scaled", F.when(finite(value), F.log1p(a * x) / math.log(a)).otherwise(NAN)).drop("__hi", "__max")


def anscombe_scale(df: DataFrame, value: str, keys: list[str], scale: float = 1.0) -> DataFrame:
    """``df`` with scaled: 2 sqrt((value - minimum) scale + 3/8) per plane; not finite is NaN."""
    clean = F.when(finite(value), F.col(value))
    low = F.min(clean).over(Window.partitionBy(*keys))
    return df.withColumn("scaled", F.when(finite(value), 2.0 * F.sqrt(F.greatest((F.col(value) - low) * scale, F.lit(0.0)) + 3.0 / 8.0)).otherwise(NAN))
