"""Objects over bands and components: linked detections against targets, centres of bright components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import NAN, ellipse_contains, finite
from lumenfold.operators import joins as J
from lumenfold.operators import pixels as P
from lumenfold.operators.graph import connected_components
from lumenfold.operators.windows import assign_stars, stars_near_clusters
from lumenfold.session import discard, stash


def footprint_span_join(spans: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x, y, image): the pixels of each source's spans (y, x0, x1 inclusive).

    A payload column of ``spans`` (array, one value a pixel) gives the values; without one the image does.
    """
    if "payload" in spans.columns:
        cells = spans.select(*keys, "id", "y", "x0", F.posexplode("payload").alias("k", "image"))
        return cells.select(*keys, "id", (F.col("x0") + F.col("k")).alias("x"), "y", "image")
    cells = spans.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*keys, "id", "x", "y")
    return cells.join(pixels.select(*keys, "x", "y", "image"), [*keys, "x", "y"]).select(*keys, "id", "x", "y", "image")


def ap2_snr_measure(centers: DataFrame, pixels: DataFrame, radius: float, inner: float, outer: float, keys: list[str], least: int = 16, least_annulus: int = 1) -> DataFrame:
    """(keys, id, flux, snr, internal, trusted): aperture sum above the annulus median, over the noise of blank apertures.

    The noise scales with the root of the share of the aperture that lies on the frame; ``internal`` says that
    all of it does. Trusted are internal measurements with a finite ratio, enough annulus pixels and a trusted noise.
    """
    noise = P.blank_aperture_noise(pixels, radius, keys, least).select(*keys, "sd", F.col("trusted").alias("known"))
    sums = P.apertures(centers, pixels, radius, inner, outer, keys, rim=False).drop("sd").withColumnRenamed("n_ap", "n").join(noise, keys)
    whole = len(P.disk_offsets(radius))
    flux = F.col("s") - F.nanvl(F.coalesce("m", F.lit(0.0)), F.lit(0.0)) * F.col("n")
    sigma = F.col("sd") * F.sqrt(F.col("n") / whole)
    found = sums.filter("n > 0").select(*keys, "id", flux.alias("flux"), F.when(sigma > 0, flux / sigma).otherwise(NAN).alias("snr"), (F.col("n") == whole).alias("internal"), "n_ann", "known")
    trusted = F.col("known") & F.col("internal") & (F.col("n_ann") >= least_annulus) & finite("snr")
    return found.select(*keys, "id", "flux", "snr", "internal", trusted.alias("trusted"))


def link_metrics(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, pattern, n): linked objects against targets by their sets of bands.

    ``members``: object, band, source_id (null: not matched); ``targets``: source_id, band. An object
    whose members all match one target in all of its bands is tp, once a target (a second is fp); one
    that matches a target in part is partial; others are fp. Targets that no object matches in full are fn.
    """
    want = targets.groupBy("source_id").agg(F.sort_array(F.collect_set("band")).alias("want"))
    sets = members.groupBy("object").agg(F.sort_array(F.collect_set("band")).alias("bands"), F.collect_set("source_id").alias("ids"), F.count_if(F.col("source_id").isNull()).alias("loose"))
    one = sets.withColumn("source_id", F.when(F.size("ids") == 1, F.get("ids", 0))).join(want, "source_id", "left")
    full = (F.col("loose") == 0) & F.col("source_id").isNotNull() & (F.size(F.array_except("want", "bands")) == 0) & (F.size(F.array_except("bands", "want")) == 0)
    ranked = one.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("n", F.row_number().over(Window.partitionBy("source_id", "full").orderBy("object")))
    kind = F.when(F.col("full") & (F.col("n") == 1), "tp").when(F.col("full"), "fp").when(F.size("ids") > 0, "partial").otherwise("fp")
    found = ranked.select(kind.alias("kind"), F.array_join("bands", "").alias("pattern"))
    hit = ranked.filter("full").select("source_id").distinct()
    missed = want.join(hit, "source_id", "left_anti").select(F.lit("fn").alias("kind"), F.array_join("want", "").alias("pattern"))
    return found.unionByName(missed).groupBy("kind", "pattern").agg(F.count("*").alias("n"))


def by_shuffle(table: DataFrame) -> DataFrame:
    """``table`` as a join's side that is not broadcast: it has rows by the number of sources or regions, of which the size of its file says little."""
    return table.hint("merge")


def component_of(points: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, px, py) with the region of ``runs`` that holds their pixel, or null."""
    cells = runs.withColumn("px", F.explode(F.sequence("x0", "x1"))).select(*keys, "px", F.col("y").alias("py"), "region")
    return points.join(by_shuffle(cells), [*keys, "px", "py"], "left")


def seeded_component_centers(runs: DataFrame, seeds: DataFrame, positives: DataFrame, keys: list[str], width: int, height: int, least: int) -> DataFrame:
    """(keys, region, cx, cy, area): centres of seeded regions without a positive source, large enough and off the edge."""
    edge = (F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)
    stats = runs.groupBy(*keys, "region").agg(F.sum("n").alias("area"), (F.sum((F.col("x0") + F.col("x1")) / 2.0 * F.col("n")) / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.bool_or(edge).alias("edge"))
    seeded = component_of(seeds, runs, keys).select("region").distinct()
    taken = component_of(positives, runs, keys).filter("region is not null").select("region").distinct()
    return stats.filter((F.col("area") >= least) & ~F.col("edge")).join(seeded, "region", "left_semi").join(taken, "region", "left_anti").select(*keys, "region", "cx", "cy", "area")


def nested_component_centers(runs: DataFrame, parents: DataFrame, centers: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys, parent, region, cx, cy): regions wholly inside one parent ellipse, with no centre within ``radius``.

    ``parents``: keys, id, x, y, a, b, theta, area. The smallest parent has the region; new centres nearer
    to each other than ``radius`` go to the smaller parent, of equal ones to the region whose first pixel comes first by rows.
    """
    middle = (F.col("x0") + F.col("x1")) / 2.0 * F.col("n")
    size = runs.groupBy(*keys, "region").agg(F.count("*").alias("rows"), (F.sum(middle) / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.min(F.struct(F.col("y").alias("fy"), F.col("x0").alias("fx"))).alias("first"))
    size = stash(size.select(*keys, "region", "rows", "cx", "cy", "first.*"), "regions")
    # A parent of the region holds its first pixel. Parents of one power of two share a grid, to which pixels come;
    # its cells are as wide as four axes, and a parent stands in all that it reaches, mostly one.
    real = parents.filter(finite("a") & finite("b") & finite("x") & finite("y"))
    turn = F.struct(F.cos("theta").alias("cos"), F.sin("theta").alias("sin"))
    leveled = stash(real.select(*keys, F.struct("id", "x", "y", "a", "b", "theta", "area", turn.alias("turn")).alias("p"), F.ceil(F.log2(F.greatest("a", "b", F.lit(1.0)))).cast("int").alias("level")), "parents")
    levels = sorted(r[0] for r in leveled.select("level").distinct().collect())  # as many as powers of two among the axes
    width = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(c / (4.0 * width))
    reached = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.001 * width), cell(F.col(c) + 1.001 * width)))
    spread = leveled.withColumn("gx", reached("p.x")).withColumn("gy", reached("p.y"))
    firsts = size.withColumn("level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumns({"gx": cell(F.col("fx")), "gy": cell(F.col("fy"))})
    inside = lambda px, py: ellipse_contains(F.col(px), F.col(py), F.col("p.x"), F.col("p.y"), F.col("p.a"), F.col("p.b"), F.col("p.theta"), F.col("p.turn"))
    near = firsts.join(by_shuffle(spread), [*keys, "level", "gx", "gy"]).filter(inside("fx", "fy")).select(*keys, "region", "rows", "cx", "cy", "fy", "fx", "p")
    # An ellipse that holds both ends of a row's run holds the run.
    held = near.join(by_shuffle(runs.select(*keys, "region", "y", "x0", "x1")), [*keys, "region"]).filter(inside("x0", "y") & inside("x1", "y"))
    place = [*keys, "region", "cx", "cy", "fy", "fx"]
    whole = held.groupBy(*place, "rows", F.col("p.id").alias("id"), F.col("p.area").alias("area")).agg(F.count("*").alias("inside")).filter("inside = rows")
    best = whole.groupBy(*place).agg(F.min(F.struct("area", "id")).alias("p"))
    # Each is read more than once: by the search for centres and what that leaves, by the choice and its result.
    best = stash(best.select(*keys, F.col("region").alias("source_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "fy", "fx", F.col("p.area").alias("area"), F.col("p.id").alias("parent")), "nested")
    discard(size, leveled)
    near = J.pairs_within(best, centers, radius, keys, "source_id", "id").select(F.col("a").alias("source_id")).distinct()
    free = stash(best.join(by_shuffle(near), "source_id", "left_anti"), "free")
    discard(best)
    lost = J.priority_dedup(free, radius, keys, [F.col("area"), F.col("fy"), F.col("fx")]).select(F.col("a").alias("source_id"))
    return free.join(by_shuffle(lost), "source_id", "left_anti").select(*keys, "parent", F.col("source_id").alias("region"), F.col("x").alias("cx"), F.col("y").alias("cy"))


@dataclass(frozen=True)
class BrightPolicy:
    """Limits of the labels of bright components."""

    drop_area: float = 10000.0
    blendedness: float = 0.5
    cluster_iou: float = 1.0 / 3.0
    cluster_distance: float = 50.0
    cluster_area: float = 10000.0
    shape_area: float = 10000.0
    shape_ratio: float = 5.0
    isolated_area: float = 1000.0
    star_mag: float = 22.0
    source_match: float = 6.0
    centroid_match: float = 10.0
    empty_area: float = 1000.0
    #: Sources of a component that are one cluster without a look at their overlaps.
    crowded: int = 256


def component_bright_labels(sources: DataFrame, runs: DataFrame, stars: DataFrame, keys: list[str], width: int, height: int, p: BrightPolicy = BrightPolicy()) -> DataFrame:
    """(keys, id, region, label, reason): sources by the bright component that holds them, and added centres.

    ``sources``: keys, source_id, x, y, a, b, theta, area, blendedness, star (class star); ``runs``: components as
    rows of pixels with region; ``stars``: keys, star_id, x, y, mag, reliable. Large areas are ignored. The rest of
    a component, or of the sky outside, is clustered by overlap; a source alone in its cluster that touches no
    other is clean, weak (large, or its component has several clusters) or, for a star, center_only, unless it is
    blended or its shape is not usable; other clusters are ignored. A reliable bright star in a component, or one
    outside that meets a cluster, turns its sources into fragments (restricted) and is added as a strict centre with
    the id -star_id - 1. Large components off the edge without any usable row, without a blend, and whose sources, if any, are
    not all other than stars, get their mean pixel as a strict centre.
    """
    at = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    area = runs.groupBy(*keys, "region").agg(F.sum("n").alias("pixels"), (F.sum((F.col("x0") + F.col("x1")) / 2.0 * F.col("n")) / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.bool_or((F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)).alias("edge"))
    own = component_of(sources.withColumns({"px": at("x"), "py": at("y")}), runs, keys).drop("px", "py").join(by_shuffle(area.select(*keys, "region", "pixels")), [*keys, "region"], "left")
    own = stash(own.withColumns({"blended": F.coalesce(F.col("blendedness") > p.blendedness, F.lit(False)), "dropped": F.col("area") >= p.drop_area, "place": F.coalesce("region", F.lit(0).cast("long"))}), "members")
    pending = own.filter("NOT dropped")
    # Sources of one component, or outside of all, may form a cluster; touching counts among them too.
    overlaps = J.ellipse_pairs(pending, [*keys, "place"]).withColumn("iou", J.pixel_iou(F.col("s"), F.col("t")))
    overlaps = stash(overlaps.select(F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.greatest("s.area", "t.area").alias("larger"), "d", "iou").filter("iou > 0"), "overlaps")
    links = overlaps.filter((F.col("iou") >= p.cluster_iou) & (F.col("d") <= p.cluster_distance) & (F.col("larger") < p.cluster_area))
    cluster = connected_components(links)
    crowds = pending.filter("region is not null").groupBy(*keys, "region").agg(F.count("*").alias("crowd"), F.min("source_id").alias("head")).filter(F.col("crowd") >= p.crowded)
    grouped = pending.join(by_shuffle(cluster.select(F.col("id").alias("source_id"), "component")), "source_id", "left").join(by_shuffle(crowds), [*keys, "region"], "left")
    grouped = grouped.withColumn("cluster", F.coalesce("head", "component", "source_id")).drop("component", "crowd", "head")
    touched = overlaps.select(F.explode(F.array("a", "b")).alias("source_id")).distinct().withColumn("touched", F.lit(True))
    sizes = grouped.groupBy("cluster").agg(F.count("*").alias("members"))
    groups = grouped.groupBy(*keys, "place").agg(F.countDistinct("cluster").alias("clusters"))
    grouped = stash(grouped.join(by_shuffle(sizes), "cluster").join(by_shuffle(groups), [*keys, "place"]).join(by_shuffle(touched), "source_id", "left").withColumn("touched", F.coalesce("touched", F.lit(False))), "grouped")
    inside = F.col("region").isNotNull()
    usable = (F.col("area") < p.shape_area) & (F.greatest("a", "b") <= p.shape_ratio * F.least("a", "b"))
    small = F.greatest(F.coalesce("pixels", F.lit(0)), "area") < p.isolated_area
    alone = (F.col("members") == 1) & ~F.col("touched")
    state = (
        F.when(alone & F.col("blended"), _state("ignore", "high_blendedness"))
        .when(alone & usable & small & ~(inside & (F.col("clusters") > 1)), _state("clean", "isolated_small"))
        .when(alone & usable & ~F.col("star"), _state("weak", "isolated_large"))
        .when(alone & usable, _state("center_only", "isolated_star"))
        .otherwise(_state("ignore", "cluster_without_star"))
    )
    bright = stars.filter(F.col("reliable") & (F.col("mag") < p.star_mag))
    held = component_of(bright.withColumns({"px": at("x"), "py": at("y")}), runs, keys).drop("px", "py")
    loose = held.filter("region is null")
    met = assign_stars(stars_near_clusters(grouped.select(*keys, "cluster", "x", "y"), loose, p.source_match, p.centroid_match, keys), keys)
    home = grouped.groupBy("cluster").agg(F.first("region").alias("region"))
    met = met.join(by_shuffle(home), "cluster")
    starred = held.filter("region is not null").select(*keys, "star_id", "region").unionByName(met.filter("region is not null").select(*keys, "star_id", "region"))
    outside = met.filter("region is null").select("cluster", "star_id")
    starred_regions = starred.select(*keys, "region").distinct().withColumn("starred", F.lit(True))
    starred_clusters = outside.select("cluster").distinct().withColumn("met", F.lit(True))
    labelled = grouped.withColumn("state", state).join(by_shuffle(starred_clusters), "cluster", "left").select(*keys, "source_id", "region", "state", "met")
    labelled = labelled.unionByName(own.filter("dropped").select(*keys, "source_id", "region", _state("ignore", "large_area").alias("state"), F.lit(None).cast("boolean").alias("met")))
    labelled = labelled.join(by_shuffle(starred_regions), [*keys, "region"], "left")
    final = F.when(F.col("starred") | F.col("met"), _state("restricted", "fragment_of_star")).otherwise(F.col("state"))
    rows = stash(labelled.select(*keys, F.col("source_id").alias("id"), "region", final.alias("state")).select(*keys, "id", "region", F.col("state.label").alias("label"), F.col("state.reason").alias("reason")), "labels")
    added = starred.select(*keys, (-F.col("star_id") - 1).alias("id"), "region").unionByName(met.filter("region is null").select(*keys, (-F.col("star_id") - 1).alias("id"), F.lit(None).cast("long").alias("region")))
    added = added.distinct().select(*keys, "id", "region", F.lit("strict").alias("label"), F.lit("reliable_star").alias("reason"))
    kinds = own.filter("region is not null").groupBy(*keys, "region").agg(F.bool_or("blended").alias("blended"), F.bool_and(~F.col("star")).alias("no_star"))
    taken = rows.filter("label <> 'ignore'").select(*keys, "region").unionByName(added.select(*keys, "region")).distinct()
    empty = area.join(by_shuffle(kinds), [*keys, "region"], "left").join(by_shuffle(taken), [*keys, "region"], "left_anti").filter((F.col("pixels") > p.empty_area) & ~F.col("edge") & ~F.coalesce("blended", F.lit(False)) & ~F.coalesce("no_star", F.lit(False)))
    centers = empty.select(*keys, F.lit(None).cast("long").alias("id"), "region", F.lit("strict").alias("label"), F.lit("empty_component_center").alias("reason"), "cx", "cy")
    return rows.unionByName(added).unionByName(centers, allowMissingColumns=True)


def _state(label: str, reason: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
