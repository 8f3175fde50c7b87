"""Exact quantiles of groups of any size, and levels of clipped values.

Groups of up to ``GROUP_ROWS`` values are sorted or counted in a task. Of larger ones no task sees all
values: counts over a grid between two values say in which part of it a rank lies, that part gets a
grid of its own, and once few values are left, or one, these are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import finite
from lumenfold.session import discard, stash

#: Values of one group that a task takes.
GROUP_ROWS = 2_000_000
#: Parts of a grid.
PARTS = 4096


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(small, keys) if keys else rows.crossJoin(F.broadcast(small))


def exact_quantiles(values: DataFrame, value: str, keys: list[str], shares: dict[str, float], most: int = GROUP_ROWS) -> DataFrame:
    """(keys, one column for each of ``shares``): quantiles of the finite values, interpolated between neighbours.

    Groups without finite values have no row.
    """
    base = stash(values.filter(finite(value)).select(*keys, F.col(value).cast("double").alias("__v")), "values")
    sizes = stash(base.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "sizes")
    large = sizes.filter(F.col("__n") > most)
    plain = lambda rows: rows.groupBy(*keys).agg(*[F.percentile("__v", q).alias(name) for name, q in shares.items()])
    if large.isEmpty():
        return plain(base) if keys else plain(base).filter(F.coalesce(*shares).isNotNull())
    small = plain(base.join(large.select(*keys), keys, "left_anti")) if keys else None
    # The ranks, from 0, that the quantiles of a large group lie between.
    places = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), near(F.lit(q) * (F.col("__n") - 1)).cast("long").alias("rank")) for up, near in ((0, F.floor), (1, F.ceil))]) for name, q in shares.items()])))
    wanted = large.select(*keys, "__n", "__lo", "__hi", places.alias("__p")).select(*keys, F.col("__p.name").alias("name"), F.col("__p.up").alias("up"), F.col("__p.rank").alias("rank"), F.col("__n").alias("n"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
    wanted, found = stash(wanted, "ranks"), None
    while True:
        # Ranges of one value are found; of those with few values the values are put in order.
        done = wanted.filter("lo = hi").select(*keys, "name", "up", F.col("lo").alias("v"))
        short = wanted.filter(f"lo < hi AND n <= {int(most)}")
        inside = _ranged(base, short, keys).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "name", "up").orderBy("__v")) - 1)
        sorted_ = inside.filter("place = rank").select(*keys, "name", "up", F.col("__v").alias("v"))
        more = stash(done.unionByName(sorted_), "found")
        found = more if found is None else found.unionByName(more)
        wide = stash(wanted.filter(f"lo < hi AND n > {int(most)}"), "wide")
        discard(wanted)
        if wide.isEmpty():
            break
        wanted = stash(_narrowed(base, wide, keys), "ranks")
        discard(wide)
    share = F.create_map(*[F.lit(x) for name, q in shares.items() for x in (name, q)])
    both = found.groupBy(*keys, "name").agg(F.max(F.when(F.col("up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("v"))).alias("b"))
    at = share[F.col("name")] * (F.col("__n") - 1)
    part = at - F.floor(at)
    level = _joined(both, large.select(*keys, "__n"), keys).select(*keys, "name", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("v"))
    out = level.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return out if small is None else small.unionByName(out)


def _ranged(base: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values of ``base`` between lo and hi of each of ``wanted``; two rows for a quantile of a group."""
    return _joined(base, wanted, keys).filter((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))


def _narrowed(base: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with lo, hi, rank and n of the part of its range in which the rank lies."""
    width = F.col("hi") / PARTS - F.col("lo") / PARTS
    part = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.col("__v") - F.col("lo"), width)).cast("int")))
    # Ranges too narrow for a grid: the least value, and what is above it.
    part = F.when(width > 0, part).otherwise(F.when(F.col("__v") == F.col("lo"), 0).otherwise(1))
    parts = _ranged(base, wanted, keys).groupBy(*keys, "name", "up", "rank", part.alias("part")).agg(F.count("*").alias("m"), F.min("__v").alias("l"), F.max("__v").alias("h"))
    # PARTS rows at most for each rank.
    before = Window.partitionBy(*keys, "name", "up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumn("upto", F.coalesce(F.sum("m").over(before), F.lit(0)))
    mine = run.filter((F.col("upto") <= F.col("rank")) & (F.col("rank") < F.col("upto") + F.col("m")))
    return mine.select(*keys, "name", "up", (F.col("rank") - F.col("upto")).alias("rank"), F.col("m").alias("n"), F.col("l").alias("lo"), F.col("h").alias("hi"))


def robust_sigma(values: DataFrame, value: str, keys: list[str], most: int = GROUP_ROWS) -> DataFrame:
    """(keys, med, sigma): median, and 1.4826 times the median distance from it."""
    clean = stash(values.filter(finite(value)).select(*keys, F.col(value).alias("__v")), "values")
    med = stash(exact_quantiles(clean, "__v", keys, {"med": 0.5}, most), "medians")
    far = _joined(clean, med, keys).select(*keys, F.abs(F.col("__v") - F.col("med")).alias("__d"))
    return _joined(med, exact_quantiles(far, "__d", keys, {"mad": 0.5}, most), keys).select(*keys, "med", (1.4826 * F.col("mad")).alias("sigma"))


def _bounds(robust: Column, med: Column, k: float, lo: Column, hi: Column, fresh: bool) -> tuple[Column, Column]:
    """The next bounds: ``k`` sigmas around the median, within the last ones unless ``fresh``; the last ones without a sigma."""
    low, high = med - k * robust, med + k * robust
    if not fresh:
        low, high = F.greatest(low, lo), F.least(high, hi)
    return F.when(robust > 0, low).otherwise(lo), F.when(robust > 0, high).otherwise(hi)


def clipped(values: DataFrame, value: str, keys: list[str], k: float = 3.0, rounds: int = 2, fresh: bool = False, fall_back: bool = False, most: int = GROUP_ROWS) -> DataFrame:
    """(keys, med, mean, sd, robust, n): of the values within k robust sigmas of the median after ``rounds`` rounds.

    A round looks at the values that the last one kept; ``fresh`` then bounds all values anew, else the
    bounds only narrow. A round without a positive sigma changes nothing; with ``fall_back`` the standard
    deviation stands in for a sigma of nought. ``values`` are read once. Groups of up to ``most`` values are
    dealt out once, and all rounds look at them where they are; larger ones go by rounds of exact
    quantiles, and only bounds, a row a group, go from one to the next.
    """
    base = stash(values.filter(finite(value)).select(*keys, F.col(value).alias("__v")), "values")
    large = stash(base.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(*keys), "large")
    if large.isEmpty():
        return _clipped_in_place(base, keys, k, rounds, fresh, fall_back)
    by_rounds = _clipped_by_rounds(base.join(large, keys, "left_semi") if keys else base, keys, k, rounds, fresh, fall_back, most)
    return by_rounds.unionByName(_clipped_in_place(base.join(large, keys, "left_anti"), keys, k, rounds, fresh, fall_back)) if keys else by_rounds


def _clipped_in_place(base: DataFrame, keys: list[str], k: float, rounds: int, fresh: bool, fall_back: bool) -> DataFrame:
    """One shuffle and one sort: every level is a window over the rows of a group."""
    group = Window.partitionBy(*keys)
    rows = base.withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
    kept = F.when((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")), F.col("__v"))
    for last in [False] * rounds + [True]:
        rows = rows.withColumn("__k", kept)
        rows = rows.withColumns({"__med": F.median("__k").over(group), "__sd": F.stddev_pop("__k").over(group)})
        if last:
            rows = rows.withColumns({"__mean": F.avg("__k").over(group), "__n": F.count("__k").over(group)})
        rows = rows.withColumn("__r", 1.4826 * F.median(F.abs(F.col("__k") - F.col("__med"))).over(group))
        if fall_back:
            rows = rows.withColumn("__r", F.when(F.col("__r") > 0, F.col("__r")).otherwise(F.col("__sd")))
        lo, hi = _bounds(F.col("__r"), F.col("__med"), k, F.col("__lo"), F.col("__hi"), fresh)
        rows = rows if last else rows.select(*keys, "__v", lo.alias("__lo"), hi.alias("__hi"))
    first = lambda c, name: F.first(c).alias(name)
    return rows.groupBy(*keys).agg(first("__med", "med"), first("__mean", "mean"), first("__sd", "sd"), first("__r", "robust"), first("__n", "n")).filter("n > 0")


def _clipped_by_rounds(base: DataFrame, keys: list[str], k: float, rounds: int, fresh: bool, fall_back: bool, most: int) -> DataFrame:
    bounds = stash(base.select(*keys).distinct().withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))}), "bounds") if keys else None
    for last in [False] * rounds + [True]:
        kept = base if bounds is None else _joined(base, bounds, keys).filter((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))).select(*keys, "__v")
        level = robust_sigma(kept, "__v", keys, most).withColumnRenamed("sigma", "robust")
        level = _joined(kept.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("sd"), F.count("*").alias("n")), level, keys)
        if fall_back:
            level = level.withColumn("robust", F.when(F.col("robust") > 0, F.col("robust")).otherwise(F.col("sd")))
        if last:
            return level.select(*keys, "med", "mean", "sd", "robust", "n")
        old = _joined(level, bounds, keys) if bounds is not None else level.withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
        lo, hi = _bounds(F.col("robust"), F.col("med"), k, F.col("__lo"), F.col("__hi"), fresh)
        bounds = stash(old.select(*keys, lo.alias("__lo"), hi.alias("__hi")), "bounds")
    raise AssertionError
