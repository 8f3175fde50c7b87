"""Filters and class rules of measured sources: Column code only, with thresholds in policies.

A rule returns a boolean or a class name; comparisons with a value that was not measured are false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.expr import all_of, any_of, area_equivalent, exceeds, finite, reason_string

#: Ranks of the classes; a downgrade only lowers.
RANKS = {"clean": 3, "weak": 2, "strict": 1, "ignore": 0}


@dataclass(frozen=True)
class SnrPolicy:
    """Signal-to-noise bounds: ignored up to the first, weak up to the second; large areas are weak longer."""

    broad: tuple[float, float] = (5.0, 7.0)
    narrow: tuple[float, float] = (3.0, 5.0)
    large_area: float = 500.0
    large_area_snr: float = 10.0


@dataclass(frozen=True)
class ClassPolicy:
    """Thresholds of the source classifier."""

    area_max: float = 10000.0
    faint_area_max: float = 900.0
    faint_mag_min: float = 28.0
    fill_area_min: float = 500.0
    fill_ratio_max: float = 0.3
    mag_range: tuple[float, float] = (22.0, 28.0)
    bright_mag: float = 22.0
    axis_ratio_max: float = 6.0
    ap2_kron_max: float = 1.0
    ap2_kron_small_component: float = 2.0
    large_component: float = 1000.0
    close_radius: float = 3.0
    containment: float = 0.8
    #: What becomes of sources that fail the area rules: the older flow ignores them, the newer one drops them.
    drop_a_failures: bool = False
    #: Overlap from which clean sources lose their shape (None: all stay clean), how far neighbours are, and which of a pair.
    overlap_iou: float | None = None
    neighbor_radius: float = 50.0
    overlap_marks: str = "both"


@dataclass(frozen=True)
class RescuePolicy:
    """Limits of sources whose aperture and Kron magnitudes are measured again."""

    threshold: float = 1.0
    clean_max: float = 1.0
    center_max: float = 1.5
    area_max: float = 10000.0
    faint_mag: float = 28.0
    faint_area: float = 900.0
    axis_ratio_max: float = 5.0
    least_fill: float = 0.2
    containment: float = 0.8


def above(c: Column, limit: float | Column) -> Column:
    return finite(c) & (c > limit)


def at_least(c: Column, limit: float | Column) -> Column:
    return finite(c) & (c >= limit)


def below(c: Column, limit: float | Column) -> Column:
    return finite(c) & (c < limit)


def at_most(c: Column, limit: float | Column) -> Column:
    return finite(c) & (c <= limit)


def source_filter(df: DataFrame, mode: str) -> DataFrame:
    """Rows of a mode: all, parent (no parent), nchild0 (no children), leaf_child (a parent, no children).

    A table without a needed column is an error.
    """
    if mode == "all":
        return df
    rules = {"parent": F.col("parent") == 0, "nchild0": F.col("n_child") == 0, "leaf_child": (F.col("parent") != 0) & (F.col("n_child") == 0)} if {"parent", "n_child"} <= set(df.columns) else {}
    if mode not in rules:
        raise ValueError(f"source filter {mode} needs parent and n_child")
    return df.filter(rules[mode])


def flag_rule(flags: dict[str, Column], mode: str = "any") -> tuple[Column, Column]:
    """(removed, reasons): whether any or all flags are set, and the names of those set.

    ``detect_isPrimary`` counts as set where it is false.
    """
    values = {n: F.coalesce(~c if n == "detect_isPrimary" else c, F.lit(False)) for n, c in flags.items()}
    removed = (any_of if mode == "any" else all_of)(list(values.values())) if values else F.lit(False)
    names = F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in values.items()]))
    return removed, F.when(removed, names).otherwise(F.array().cast("array<string>"))


def area_policy(area: Column, bright: Column, policy: str, limit: float = 400.0, relaxed: float = 900.0) -> Column:
    """Kept by area: at most ``limit``, or below it, or below ``relaxed`` and away from bright objects."""
    if policy == "max_area":
        return at_most(area, limit)
    if policy == "area400_or_area900_not_bright":
        return below(area, limit) | (below(area, relaxed) & ~F.coalesce(bright, F.lit(False)))
    raise ValueError(policy)


def a_rule(area: Column, mag: Column, p: ClassPolicy = ClassPolicy(), scale: float = 0.168) -> tuple[Column, Column]:
    """(dropped, failed): too large at all, and too large for its faintness; areas count in reference pixels."""
    same = area_equivalent(area, scale)
    return exceeds(same, p.area_max), exceeds(same, p.faint_area_max) & above(mag, p.faint_mag_min)


def bright_ap2_rule(diff: Column, component_area: Column, invalid_fails: bool, p: ClassPolicy = ClassPolicy()) -> Column:
    """Removed by the aperture against Kron magnitude: limit 1 outside components, 2 in small ones, none in large ones.

    The two flows differ on differences that were not measured: ``invalid_fails`` says which.
    """
    inside = above(component_area, 0.0)
    limit = F.when(inside & (component_area >= p.large_component), F.lit(None)).when(inside, p.ap2_kron_small_component).otherwise(p.ap2_kron_max)
    return F.coalesce(F.when(finite(diff), F.abs(diff) >= limit).otherwise(limit.isNotNull() if invalid_fails else F.lit(False)), F.lit(False))


def b_rule(mag: Column, ratio: Column, diff: Column, matched: Column, flagged: Column, p: ClassPolicy = ClassPolicy(), need_match: bool = False) -> Column:
    """Removed by magnitude range, axis ratio, aperture against Kron, refit match or flags; bright sources skip most of it."""
    ordinary = ~below(mag, p.bright_mag)
    in_range = at_least(mag, p.mag_range[0]) & (mag <= p.mag_range[1])
    close = finite(diff) & (F.abs(diff) < p.ap2_kron_max)
    removed = (ordinary & ~in_range) | above(ratio, p.axis_ratio_max) | (ordinary & ~close) | (ordinary & flagged)
    return removed | ~F.coalesce(matched, F.lit(False)) if need_match else removed


def fill_center_only(area: Column, fill: Column, p: ClassPolicy = ClassPolicy()) -> Column:
    return above(area, p.fill_area_min) & below(fill, p.fill_ratio_max)


def saturation_demote(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Clean sources brighter than their band's limit become strict_center_only, with a reason appended.

    ``limits``: (band, limit), one row a band of the survey. A band without a limit is an error.
    """
    missing = df.select("band").distinct().join(limits, "band", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no saturation limit for band {missing[0]['band']}")
    joined = df.join(F.broadcast(limits), "band")
    hit = (F.col("class") == "clean") & below(F.col("mag"), F.col("limit"))
    return joined.withColumns({"class": F.when(hit, "strict_center_only").otherwise(F.col("class")), "reason": F.when(hit, F.concat_ws(";", F.nullif("reason", F.lit("")), F.lit("saturated"))).otherwise(F.col("reason"))}).drop("limit")


def snr_class(snr: Column, narrow: Column, area: Column | None = None, p: SnrPolicy = SnrPolicy()) -> Column:
    """ignore, weak_shape or clean; bounds are exclusive, so that a value on one takes the lower class."""
    low = F.when(narrow, p.narrow[0]).otherwise(p.broad[0])
    high = F.when(narrow, p.narrow[1]).otherwise(p.broad[1])
    out = F.when(above(snr, high), "clean").when(above(snr, low), "weak_shape").otherwise("ignore")
    if area is None:
        return out
    return F.when(above(snr, low) & at_most(snr, p.large_area_snr) & above(area, p.large_area), "weak_shape").otherwise(out)


def snr_post_filter(old: Column, snr: Column, area: Column, low: float = 3.0, high: float = 5.0, large_area: float = 500.0, large_snr: float = 7.0) -> tuple[Column, Column]:
    """(class, reason) after a second look at the ratio: never higher, and a clean source on the bound stays clean."""
    known = old.isin("clean", "center_only", "strict_center_only", "ignore")
    base = F.when(old == "strict_center_only", "center_only").otherwise(old)
    cases = [
        (~known, old, "unchanged"),
        (~finite(snr), F.lit("ignore"), "snr_invalid"),
        (snr <= low, F.lit("ignore"), "snr_low"),
        (base == "ignore", F.lit("ignore"), "kept_ignore"),
        (above(area, large_area) & (snr <= large_snr), F.lit("center_only"), "large_area"),
        ((base == "clean") & (snr < high), F.lit("center_only"), "clean_low"),
    ]
    cls, reason = base, F.lit("kept")
    for when, to, why in reversed(cases):
        cls, reason = F.when(when, to).otherwise(cls), F.when(when, F.lit(why)).otherwise(reason)
    return cls, reason


def visibility_class(snr: Column, annulus_pixels: Column, least_pixels: int = 2, normal: float = 3.0, center: float = 2.0) -> Column:
    few = annulus_pixels < least_pixels
    return F.when(few, "center_only").when(at_least(snr, normal), "normal").when(at_least(snr, center), "center_only").otherwise("ignore")


def visibility_keep(df: DataFrame, mode: str) -> DataFrame:
    """Rows of a mode: raw, snr_ge2 or snr_ge3."""
    if mode == "raw":
        return df
    return df.filter(at_least(F.col("snr"), {"snr_ge2": 2.0, "snr_ge3": 3.0}[mode]))


def refit_row_select(df: DataFrame, low: float, high: float, limit: int | None = None) -> DataFrame:
    """Primary, unflagged leaves in a magnitude range with a positive moment determinant; the first ``limit`` by id."""
    good = at_least(F.col("mag"), low) & (F.col("mag") <= high) & F.col("detect_isPrimary") & ~F.col("f_edge") & ~F.col("f_bad") & (F.col("n_child") == 0) & above(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), 0.0)
    out = df.filter(good)
    return out if limit is None else out.orderBy("source_id").limit(limit)


def snr_row_filter(df: DataFrame, cut: float) -> DataFrame:
    """Rows at or above the cut or not trusted, with class_id 7 for the latter and else 1."""
    trusted = F.coalesce(F.col("trusted"), F.lit(False))
    return df.filter(at_least(F.col("snr"), cut) | ~trusted).withColumn("class_id", F.when(trusted, 1).otherwise(7))


def ap2_kron_split(df: DataFrame, most: float = 1.0) -> DataFrame:
    """``df`` with split: kept (difference at most ``most``), rejected, or invalid."""
    d = F.col("diff")
    return df.withColumn("split", F.when(~finite(d) | F.col("source_id").isNull(), "invalid").when(F.abs(d) <= most, "kept").otherwise("rejected"))


def pixel_half_up(c: Column) -> Column:
    """The pixel of a centre by floor(x + 0.5)."""
    return F.floor(c + 0.5).cast("int")


def pixel_half_even(c: Column) -> Column:
    """The pixel of a centre by rounding halves to even."""
    return F.bround(c).cast("int")


def downgrade(current: Column, new: Column) -> Column:
    """(class, reason) structs: the new one where its class ranks lower."""
    table = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.when(new["class"].isNotNull() & (table[new["class"]] < table[current["class"]]), new).otherwise(current)


def category_tags(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order of their names."""
    return reason_string(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def contract_check(df: DataFrame, schema: dict[str, str], keys: list[str]) -> DataFrame:
    """A report (name, ok): each column with its type, rows at all, and unique keys."""
    spark = df.sparkSession
    have = dict(df.dtypes)
    columns = spark.createDataFrame([(f"column:{n}", have.get(n) == t) for n, t in schema.items()], "name string, ok boolean")
    rows = df.agg(F.lit("rows").alias("name"), (F.count("*") > 0).alias("ok"))
    unique = df.groupBy(*keys).count().agg(F.lit("unique").alias("name"), (F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("ok"))
    return columns.unionByName(rows).unionByName(unique)


def confidence_points(df: DataFrame, snr: Column, narrow: Column, p: SnrPolicy = SnrPolicy()) -> DataFrame:
    """Sources whose signal-to-noise class is not ignore."""
    return df.filter(snr_class(snr, narrow, p=p) != "ignore")
