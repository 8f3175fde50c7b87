"""Operators on pixel tables (keys, x, y, value): offsets, runs, regions, apertures, backgrounds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.functions.expr import NAN, finite
from lumenfold.operators.ellipses import rows_of, shape
from lumenfold.operators.graph import connected_components
from lumenfold.operators.rules import pixel_half_even, pixel_half_up
from lumenfold.operators.selection import clipped, exact_quantiles, robust_sigma  # noqa: F401
from lumenfold.session import ship_package, stash


def disk_offsets(radius: float, inner: float = -1.0) -> list[tuple[int, int]]:
    """Integer offsets with inner^2 < dx^2 + dy^2 <= radius^2."""
    n = int(radius)
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if (inner * inner if inner >= 0 else -1) < dx * dx + dy * dy <= radius * radius]


def offset_table(spark: SparkSession, offsets: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(offsets, "dx int, dy int")


#: The least side of a tile, and the values of pixels that are looked up in one step.
TILE, VALUES_AT_ONCE = 64, 1 << 20


def measured_around(centers: DataFrame, pixels: DataFrame, offsets: list[tuple[int, int]], keys: list[str], carry: list[str], measure: Callable[..., dict], fields: str, value: str = "image") -> DataFrame:
    """(keys, id, fields): what ``measure`` makes of the pixels at the offsets around each of ``centers`` (keys, id, px, py).

    Centres and pixels go to square tiles, pixels also to those next to theirs that they are in reach of, so that a
    pixel travels about once and not once for each centre. In a tile ``measure`` gets NumPy arrays: the values (a row a
    centre, a column an offset; NaN where there is no pixel), the pixels' distances dx and dy alike, and the columns
    ``carry`` of the centres, as doubles; it gives arrays by name, and ``found``, which centres have a row.
    ``pixels`` has one row a pixel, with a finite value, and ``centers`` one an id.
    """
    ship_package(centers.sparkSession)
    reach = max(max(abs(dx), abs(dy)) for dx, dy in offsets) + 1  # a centre between pixels is that much farther from some
    side, at_once = max(TILE, 4 * reach), VALUES_AT_ONCE
    ox, oy = np.array([o[0] for o in offsets]), np.array([o[1] for o in offsets])
    tile = lambda c: F.floor(c / side).cast("long")
    held = centers.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ("px", "py", *carry)]).filter(finite("px") & finite("py"))
    held = held.dropna(subset=keys).withColumns({"__tx": tile(F.col("px")), "__ty": tile(F.col("py"))})
    near = lambda c: F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach)))
    # Keys by new columns: those of centres and pixels of one table would else be the same ones, which a cogroup cannot tell apart.
    known = pixels.select(*[F.col(k).alias(k) for k in keys], F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("v")).withColumn("__tx", near("x")).withColumn("__ty", near("y"))
    schema = T.StructType([*[held.schema[k] for k in [*keys, "id"]], *T.StructType.fromDDL(fields).fields])
    first, names = len(keys), schema.names

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, n: t.column(n).to_numpy()
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pydict({n: [] for n in names}, wanted)
        px, py = column(left, "px"), column(left, "py")
        x0, y0 = column(left, "__tx")[0] * side - reach, column(left, "__ty")[0] * side - reach
        grid = np.full((side + 2 * reach, side + 2 * reach), np.nan)
        grid[column(right, "y") - y0, column(right, "x") - x0] = column(right, "v")
        made, kept, step = [], [], max(1, at_once // len(ox))
        for i in range(0, len(px), step):
            j = slice(i, i + step)
            x, y = (np.trunc(p[j][:, None] + o).astype(np.int64) for p, o in ((px, ox), (py, oy)))
            got = measure(grid[y - y0, x - x0], x - px[j][:, None], y - py[j][:, None], *[column(left, c)[j][:, None] for c in carry])
            kept.append(got.pop("found"))
            made.append(got)
        keep = np.concatenate(kept)
        columns = [left.column(n).filter(pa.array(keep)) for n in names[: first + 1]]
        return pa.Table.from_arrays([*columns, *[pa.array(np.concatenate([g[n] for g in made])[keep]) for n in names[first + 1 :]]], names=names).cast(wanted)

    wanted = to_arrow_schema(schema)
    by = [*keys, "__tx", "__ty"]
    return held.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(work, schema)


def aperture_sums(values: np.ndarray, dx: np.ndarray, dy: np.ndarray, radius: float, inner: float, outer: float) -> dict[str, np.ndarray]:
    """Sum and number of the values within ``radius``; number, median and sample deviation of those beyond ``inner`` and within ``outer``."""
    r2 = dx * dx + dy * dy
    ap, ann = np.where(r2 <= radius * radius, values, np.nan), np.where((r2 > inner * inner) & (r2 <= outer * outer), values, np.nan)
    n_ap, n = np.isfinite(ap).sum(1), np.isfinite(ann).sum(1)
    ranked = np.sort(ann, axis=1)  # NaN come last
    at = lambda k: np.take_along_axis(ranked, np.clip(k, 0, ranked.shape[1] - 1)[:, None], 1)[:, 0]
    low, high = at((n - 1) // 2), at(n // 2)
    m = np.where(low == high, low, 0.5 * low + 0.5 * high)
    # About the median, so that equal values deviate by exactly nothing.
    off = ann - m[:, None]
    off = off - (np.nansum(off, axis=1) / np.maximum(n, 1))[:, None]
    sd = np.where(n > 1, np.sqrt(np.nansum(off * off, axis=1) / np.maximum(n - 1, 1)), np.nan)
    return {"found": np.isfinite(values).any(1), "s": np.nansum(ap, axis=1), "n_ap": n_ap, "n_ann": n, "m": m, "sd": sd}


def row_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1, n): runs of consecutive pixels of a row."""
    step = F.when(F.col("x") - F.lag("x").over(Window.partitionBy(*keys, "y").orderBy("x")) == 1, 0).otherwise(1)
    numbered = pixels.withColumn("__new", step).withColumn("__run", F.sum("__new").over(Window.partitionBy(*keys, "y").orderBy("x")))
    return numbered.groupBy(*keys, "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")).drop("__run")


def regions(pixels: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """The runs of ``pixels`` with region, the least run id that touching rows connect."""
    reach = 1 if diagonal else 0
    runs = stash(row_runs(pixels, keys).withColumn("run", F.xxhash64(*keys, "y", "x0")), "rows")  # read three times
    below = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("run").alias("b"))
    touch = runs.join(below.hint("merge"), [*keys, "y"]).filter((F.col("x0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("x1") + reach))
    found = connected_components(touch.select(F.col("run").alias("a"), "b"))
    return runs.join(found.withColumnRenamed("id", "run").hint("merge"), "run", "left").withColumn("region", F.coalesce("component", "run")).drop("component")


def component_stats(pixels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, region, area, cx, cy, touches_edge, share): of each connected region; share of its plane's masked pixels."""
    r = regions(pixels, keys)
    edge = (F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)
    sums = r.groupBy(*keys, "region").agg(F.sum("n").alias("area"), F.sum((F.col("x0") + F.col("x1")) / 2.0 * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"), F.bool_or(edge).alias("touches_edge"), F.min(F.struct("y", "x0")).alias("first"))
    share = F.col("area") / F.sum("area").over(Window.partitionBy(*keys))
    return sums.select(*keys, F.col("first.y").alias("y0"), F.col("first.x0").alias("x0"), "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"), "touches_edge", share.alias("share"))


def plane_fractions(pixels: DataFrame, planes: dict[str, int], keys: list[str]) -> DataFrame:
    """Per plane: share of pixels of each mask plane, of any, of finite and of positive values, and exact percentiles.

    Shares are partial sums, and percentiles of large planes come by selection, so no task has to hold a plane.
    """
    on = {n: F.col("mask").bitwiseAND(F.lit(1 << b)) != 0 for n, b in planes.items()}
    share = lambda c: F.avg(c.cast("double"))
    union = F.col("mask").bitwiseAND(F.lit(sum(1 << b for b in planes.values()))) != 0
    clean = F.when(finite("image"), F.col("image"))
    pixels = stash(pixels.select(*keys, "mask", "image"), "plane")
    shares = pixels.groupBy(*keys).agg(*[share(c).alias(n) for n, c in on.items()], share(union).alias("any"), share(finite("image")).alias("finite"), share(F.coalesce(clean > 0, F.lit(False))).alias("positive"))
    return shares.join(exact_quantiles(pixels, "image", keys, {f"p{q}": q / 100 for q in (1, 50, 99)}), keys, "left")


def tile_bad_score(pixels: DataFrame, score: Column, tile: int, stride: int, keys: list[str]) -> DataFrame:
    """(keys, tx, ty, score): mean score of the tiles that start each ``stride`` pixels and are ``tile`` wide.

    Scores are summed in whole millionths, so that the order of the pixels does not tell.
    """
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / stride)).cast("int")
    last = lambda c: F.floor(F.col(c) / stride).cast("int")
    scored = pixels.withColumn("__s", F.round(score * 1e6).cast("long"))
    spread = scored.withColumn("tx", F.explode(F.sequence(first("x"), last("x")))).withColumn("ty", F.explode(F.sequence(first("y"), last("y"))))
    return spread.groupBy(*keys, "tx", "ty").agg((F.sum("__s") / F.count("__s") / 1e6).alias("score"))


def mean_in_aperture(centers: DataFrame, pixels: DataFrame, radius: float, keys: list[str], value: str = "image") -> DataFrame:
    """(keys, id, mean, n): mean of finite positive values in a disk."""

    def means(values, dx, dy):
        n = np.isfinite(values).sum(1)
        return {"found": n > 0, "mean": np.nansum(values, axis=1) / np.maximum(n, 1), "n": n}

    return measured_around(centers, pixels.filter(finite(value) & (F.col(value) > 0)), disk_offsets(radius), keys, [], means, "mean double, n long", value)


def ellipse_aperture_sum(centers: DataFrame, pixels: DataFrame, reach: int, keys: list[str], value: str = "image") -> DataFrame:
    """(keys, id, total, n): sum and number of finite pixels inside each centre's ellipse (a, b, theta).

    ``reach`` bounds the axes: pixels farther from the centre are not looked at.
    """
    box = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]
    shaped = centers.withColumns({"__a": F.greatest("a", F.lit(1e-6)), "__b": F.greatest("b", F.lit(1e-6)), "__cos": F.cos("theta"), "__sin": F.sin("theta")})

    def sums(values, dx, dy, a, b, cos, sin):
        u, v = (cos * dx + sin * dy) / a, (-sin * dx + cos * dy) / b
        inside = np.where(u * u + v * v <= 1.0, values, np.nan)
        n = np.isfinite(inside).sum(1)
        return {"found": n > 0, "total": np.nansum(inside, axis=1), "n": n}

    return measured_around(shaped, pixels.filter(finite(value)), box, keys, ["__a", "__b", "__cos", "__sin"], sums, "total double, n long", value)


def count_around(centers: DataFrame, pixels: DataFrame, offsets: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """(keys, id, n): number of pixels (keys, x, y) at the offsets around each centre that has any."""

    def count(values, dx, dy):
        n = np.isfinite(values).sum(1)
        return {"found": n > 0, "n": n}

    return measured_around(centers, pixels.withColumn("__one", F.lit(1.0)), offsets, keys, [], count, "n long", "__one")


def apertures(centers: DataFrame, pixels: DataFrame, radius: float, inner: float, outer: float, keys: list[str], rim: bool = True) -> DataFrame:
    """(keys, id, s, n_ap, n_ann, m, sd): :func:`aperture_sums` of the finite pixels that are not ``excluded``; without ``rim`` all that are looked at are within ``outer``."""
    end = outer if rim else math.inf
    measure = lambda values, dx, dy: aperture_sums(values, dx, dy, radius, inner, end)
    return measured_around(centers, pixels.filter(finite("image") & ~F.col("excluded")), disk_offsets(outer), keys, [], measure, "s double, n_ap long, n_ann long, m double, sd double")


def aperture_annulus_snr(centers: DataFrame, pixels: DataFrame, radius: float, inner: float, outer: float, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, id, snr, n_ap, n_ann): the aperture's sum above the annulus median, over the annulus scatter.

    Excluded pixels (a true column ``excluded``) count in neither. Too few annulus pixels give NaN.
    """
    sums = apertures(centers, pixels, radius, inner, outer, keys)
    good = (F.col("n_ann") >= least) & (F.col("n_ap") > 0) & (F.col("sd") > 0)
    return sums.select(*keys, "id", F.when(good, (F.col("s") - F.col("m") * F.col("n_ap")) / (F.col("sd") * F.sqrt("n_ap"))).otherwise(NAN).alias("snr"), "n_ap", "n_ann")


def sigma_clip(values: DataFrame, value: str, keys: list[str], k: float = 3.0, rounds: int = 3) -> DataFrame:
    """(keys, med, mean, sd, n): after a fixed number of rounds that keep values within k robust sigmas of the median."""
    return clipped(values, value, keys, k, rounds).drop("robust")


def block_background(pixels: DataFrame, box: int, keys: list[str], value: str = "image", least: int | None = None) -> DataFrame:
    """(keys, bx, by, med, sigma, reliable): clipped level of each box, or its plane's where the box says too little.

    Two rounds of three sigmas. A box is reliable with at least ``least`` values left (default: 64, and a
    sixteenth of its pixels) and a positive sigma. A plane without one has 1.
    """
    box = max(box, 8)
    least = max(64, box * box // 16) if least is None else least
    pixels = stash(pixels.select(*keys, "x", "y", value), "plane")
    boxed = pixels.withColumns({"bx": F.floor(F.col("x") / box), "by": F.floor(F.col("y") / box)})
    sigma = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.col("robust"))
    own = clipped(boxed, value, [*keys, "bx", "by"], fall_back=True).withColumn("sigma", sigma)
    whole = clipped(pixels, value, keys, fall_back=True).select(*keys, F.col("med").alias("g_med"), F.when(sigma > 0, sigma).otherwise(1.0).alias("g_sigma"))
    ok = F.coalesce((F.col("n") >= least) & (F.col("sigma") > 0), F.lit(False))
    found = boxed.select(*keys, "bx", "by").distinct().join(own, [*keys, "bx", "by"], "left").join(whole, keys, "left")
    return found.select(*keys, "bx", "by", F.when(ok, F.col("med")).otherwise(F.coalesce("g_med", F.lit(0.0))).alias("med"), F.when(ok, F.col("sigma")).otherwise(F.coalesce("g_sigma", F.lit(1.0))).alias("sigma"), ok.alias("reliable"))


def blank_aperture_noise(pixels: DataFrame, radius: float, keys: list[str], least: int = 16) -> DataFrame:
    """(keys, med, sd, robust, n, trusted): clipped scatter of the aperture sums at all places whose pixels are all finite and free.

    Two rounds of three sigmas. ``n`` counts the apertures before clipping: trusted are at least ``least``
    of them with a positive scatter.
    """
    offsets = disk_offsets(radius)
    free = pixels.filter(finite("image") & ~F.col("excluded"))
    spread = free.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])))
    sums = spread.groupBy(*keys, (F.col("x") - F.col("__o.dx")).alias("cx"), (F.col("y") - F.col("__o.dy")).alias("cy")).agg(F.sum("image").alias("total"), F.count("*").alias("n")).filter(F.col("n") == len(offsets))
    sums = stash(sums.select(*keys, "total"), "apertures")
    counts = sums.groupBy(*keys).agg(F.count("*").alias("apertures"))
    found = clipped(sums.select(*keys, "total"), "total", keys, fresh=True).drop("n").join(counts, keys)
    return found.select(*keys, "med", "sd", "robust", F.col("apertures").alias("n"), ((F.col("apertures") >= least) & (F.col("sd") > 0)).alias("trusted"))


def dense_label_priority(claims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, label): of all claims on a pixel (label, priority) the one painted last."""
    return claims.groupBy(*keys, "x", "y").agg(F.max_by("label", F.struct("priority", "label")).alias("label"))


def rasterize_ellipse(ellipses: DataFrame, width: int, height: int) -> DataFrame:
    """(id, x, y): pixels inside each ellipse (id, cx, cy, a, b, theta), clipped to the frame; a pixel on the rim is inside.

    Rows are spanned in closed form, so no pixel is made that is not inside. Ellipses are dealt to all tasks
    before they become pixels, as the file of a table of ellipses may be small enough for a few tasks.
    """
    reach = F.greatest("a", "b")
    low, high = F.greatest(F.lit(0), F.ceil(F.col("cy") - reach) - 1), F.least(F.lit(height - 1), F.floor(F.col("cy") + reach) + 1)
    real = finite("cx") & finite("cy") & finite("a") & finite("b") & finite("theta") & (F.least("a", "b") > 0)
    tasks = int(ellipses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ellipses.select("id", "cx", "cy", "a", "b", "theta").filter(real & (low <= high)).repartition(tasks, "id")
    shaped = dealt.select("id", low.alias("low"), high.alias("high"), rows_of(shape(F.col("cx"), F.col("cy"), F.col("a"), F.col("b"), F.col("theta"))).alias("e")).select("id", "low", "high", "e.*")
    rows = shaped.select("id", F.col("x").alias("cx"), F.col("y").alias("cy"), "slope", "top", "bend", F.explode(F.sequence("low", "high")).alias("y"))
    dy = F.col("y").cast("double") - F.col("cy")
    # Plain columns, not a lambda, so that all of it runs inside the generated code.
    ends = rows.select("id", "y", (F.col("cx") - F.col("slope") * dy).alias("mid"), F.sqrt(F.col("top") - F.col("bend") * dy * dy).alias("half"))
    x0, x1 = F.ceil(F.greatest(F.lit(0.0), F.col("mid") - F.col("half"))).cast("int"), F.floor(F.least(F.lit(width - 1.0), F.col("mid") + F.col("half"))).cast("int")
    meets = ~F.isnan("half") & (F.col("mid") - F.col("half") <= width - 1.0) & (F.col("mid") + F.col("half") >= 0.0)
    spans = ends.select("id", F.col("y").cast("int").alias("y"), F.when(meets, F.struct(x0.alias("x0"), x1.alias("x1"))).alias("s")).select("id", "y", "s.x0", "s.x1")
    return spans.select("id", F.explode(F.when(F.col("x0") <= F.col("x1"), F.sequence("x0", "x1"))).alias("x"), "y")


def bright_region_mask(pixels: DataFrame, z: str, threshold: float, grow: float, keys: list[str]) -> DataFrame:
    """(keys, x, y): pixels of the plane within ``grow`` of one whose z is above the threshold."""
    seeds = pixels.filter(finite(z) & (F.col(z) > threshold)).select(*keys, "x", "y")
    grown = seeds.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in disk_offsets(grow)])))
    near = grown.select(*keys, (F.col("x") + F.col("__o.dx")).alias("x"), (F.col("y") + F.col("__o.dy")).alias("y")).distinct()
    return pixels.select(*keys, "x", "y").join(near, [*keys, "x", "y"], "left_semi")


def pixel_mask_runs(pixels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, counts, area): column-major run lengths of off and on pixels in turn, beginning with off; area is their odd part."""
    flat = pixels.select(*keys, (F.col("x") * height + F.col("y")).cast("long").alias("p"))
    order = Window.partitionBy(*keys).orderBy("p")
    # A mask's runs are one array by definition: the array is what the operator returns.
    runs = flat.withColumn("__new", F.when(F.col("p") - F.lag("p").over(order) == 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    spans = runs.groupBy(*keys, "__run").agg(F.min("p").alias("s"), (F.max("p") + 1).alias("e")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("spans", i - 1)["e"])
    counts = F.flatten(F.transform("spans", lambda s, i: F.array(s["s"] - before(i), s["e"] - s["s"])))
    total = width * height
    tail = F.when(F.element_at("spans", -1)["e"] < total, F.array(total - F.element_at("spans", -1)["e"])).otherwise(F.array().cast("array<long>"))
    area = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return spans.select(*keys, F.concat(counts, tail).alias("counts"), area.alias("area"))


#: Fixed value: mean radius of the central pixel, in pixels.
CENTRAL_PIXEL = 0.38259771140356325


def kron_moment(spans: DataFrame, pixels: DataFrame, sources: DataFrame, keys: list[str], sigma: float = 6.0) -> DataFrame:
    """(id, radius, candidate, moment, total, positive, negative, n, central): first radial moment inside ``sigma`` times the ellipse.

    ``spans``: keys, id, y, x0, x1 (inclusive); ``sources``: id, cx, cy, a, b, theta. Pixels that are not
    finite, or not there, count as 0. A pixel's radius runs along the major axis, and in the central pixel
    it has a least value. The candidate is the first moment (sum r I over sum I, where both are positive)
    times sqrt(b / a); one that is no larger than the ellipse's own radius sqrt(a b) gives ``sigma`` times that.
    """
    cells = spans.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*keys, "id", "x", "y").join(pixels.select(*keys, "x", "y", "image"), [*keys, "x", "y"], "left").join(sources, "id")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    cells = cells.withColumns({"u": F.cos("theta") * dx + F.sin("theta") * dy, "v": -F.sin("theta") * dx + F.cos("theta") * dy, "far": F.sqrt(dx * dx + dy * dy)})
    value = F.when(finite("image"), F.col("image")).otherwise(0.0)
    along = F.sqrt(F.col("u") * F.col("u") + F.pow(F.col("v") * (F.col("a") / F.col("b")), 2.0))
    central = F.col("far") < 0.5
    least = CENTRAL_PIXEL * (1.0 + F.col("far") / math.sqrt(2.0))
    r = F.when(central, F.sqrt(along * along + least * least)).otherwise(along)
    inside = F.pow(F.col("u") / (sigma * F.col("a")), 2.0) + F.pow(F.col("v") / (sigma * F.col("b")), 2.0) <= 1.0
    cells = cells.filter((F.col("a") > 0) & (F.col("b") > 0)).select("id", "a", "b", value.alias("i"), r.alias("r"), inside.alias("inside"), central.alias("central"))
    on = lambda c: F.coalesce(F.sum(F.when(F.col("inside"), c)), F.lit(0.0))
    sums = cells.groupBy("id").agg(F.first("a").alias("a"), F.first("b").alias("b"), on(F.col("i")).alias("total"), on(F.col("r") * F.col("i")).alias("weighted"), on(F.greatest("i", F.lit(0.0))).alias("positive"), on(F.least("i", F.lit(0.0))).alias("negative"), F.count_if("inside").alias("n"), F.count_if("central").alias("central"))
    good = (F.col("total") > 0) & (F.col("weighted") > 0)
    moment = F.when(good, F.col("weighted") / F.col("total")).otherwise(NAN)
    own = F.sqrt(F.col("a") * F.col("b"))
    found = sums.withColumn("moment", moment).withColumn("candidate", F.when(good, F.col("moment") * F.sqrt(F.col("b") / F.col("a"))).otherwise(NAN))
    radius = F.when(good & (F.col("candidate") <= own), sigma * own).otherwise(F.col("candidate"))
    return found.select("id", radius.alias("radius"), "candidate", "moment", "total", "positive", "negative", "n", "central")


def points_in_mask(points: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, x, y) whose pixel is on in ``mask`` (keys, x, y): the pixel that holds them."""
    on = mask.select(*keys, F.col("x").alias("__mx"), F.col("y").alias("__my"))
    return points.withColumns({"__mx": F.floor("x"), "__my": F.floor("y")}).join(on, [*keys, "__mx", "__my"], "left_semi").drop("__mx", "__my")


def mask_at_center(points: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with the mask of their nearest pixel, halves to even; NULL off the frame."""
    values = planes.select(*keys, F.col("x").alias("__mx"), F.col("y").alias("__my"), "mask")
    return points.withColumns({"__mx": pixel_half_even(F.col("x")), "__my": pixel_half_even(F.col("y"))}).join(values, [*keys, "__mx", "__my"], "left").drop("__mx", "__my")


def center_validity(points: DataFrame, planes: DataFrame, ok: Column, keys: list[str]) -> DataFrame:
    """``points`` with valid: whether their nearest pixel, halves up, is on the frame and ``ok``."""
    values = planes.select(*keys, F.col("x").alias("__mx"), F.col("y").alias("__my"), ok.alias("valid"))
    return points.withColumns({"__mx": pixel_half_up(F.col("x")), "__my": pixel_half_up(F.col("y"))}).join(values, [*keys, "__mx", "__my"], "left").withColumn("valid", F.coalesce("valid", F.lit(False))).drop("__mx", "__my")
