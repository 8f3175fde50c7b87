"""Equi-joins by id, and joins by sky position.

Positions are joined through cells: a cell is as wide as four radii, one side goes to its own cell and
the other to those that the radius reaches, mostly one, so that Spark joins on equal cells and compares the distance after.
These joins are by shuffle: the size of a file says little about the rows of points in it, which a broadcast would hold whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import finite, turned
from lumenfold.operators import sequential as Q
from lumenfold.operators.ellipses import coverage, pixel_iou, unit_grid
from lumenfold.operators.graph import connected_components
from lumenfold.session import discard, stash


def refit_attach(sources: DataFrame, refit: DataFrame) -> DataFrame:
    """``sources`` with the refit's columns by source_id, and matched."""
    return sources.join(refit.withColumn("matched", F.lit(True)), "source_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one that comes last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def id_align(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Common ids of two catalogs, the last of repeated ids; columns a_<c> and b_<c>."""
    named = lambda df, p: last_by(df, key, order).select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
    return named(a, "a").join(named(b, "b"), key)


def id_exclude(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_anti")


def _cells(df: DataFrame, radius: float, reach: bool) -> DataFrame:
    """``df`` with its cell, as wide as four radii; with ``reach`` once for each cell within the radius, mostly one."""
    cell = lambda c: F.floor(c / (4.0 * radius))
    if not reach:
        return df.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    # Slack, as a cell's edge is met by another sum than the distance; places that are not finite are near nothing.
    near = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.001 * radius), cell(F.col(c) + 1.001 * radius)))
    return df.filter(finite("x") & finite("y")).withColumn("cx", near("x")).withColumn("cy", near("y"))


def pairs_within(left: DataFrame, right: DataFrame, radius: float, by: list[str], left_id: str = "id", right_id: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, d): pairs of a left and a right point of one group within ``radius`` (<=).

    Columns ``carry`` of both sides come along as a_<c> and b_<c>, so that they need no join after.
    """
    a = left.select(*by, F.col(left_id).alias("a"), "x", "y", *[F.col(c).alias(f"a_{c}") for c in carry])
    b = right.select(*by, F.col(right_id).alias("b"), "x", "y", *[F.col(c).alias(f"b_{c}") for c in carry])
    joined = _cells(a, radius, False).withColumnsRenamed({"x": "ax", "y": "ay"}).join(_cells(b, radius, True).hint("merge"), [*by, "cx", "cy"])
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    return joined.withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= radius).select(*by, "a", "b", "d", *[f"{p}_{c}" for c in carry for p in "ab"])


def close_pairs(points: DataFrame, radius: float, by: list[str], id_col: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of points of one group within ``radius``."""
    return pairs_within(points, points, radius, by, id_col, id_col, carry).filter("a < b")


def within_any_radius(points: DataFrame, centers: DataFrame, radius: float, by: list[str], id_col: str = "id", center_id: str = "id") -> DataFrame:
    """Points within ``radius`` of any centre."""
    near = pairs_within(points, centers, radius, by, id_col, center_id).select(F.col("a").alias(id_col)).distinct()
    return points.join(near, id_col, "left_semi")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, by: list[str], id_col: str = "id", target_id: str = "id") -> DataFrame:
    """(by, a, b, d): the nearest target of each point within ``radius``; ties go to the least id."""
    near = pairs_within(points, targets, radius, by, id_col, target_id)
    return near.groupBy(*by, "a").agg(F.min(F.struct("d", "b")).alias("n")).select(*by, "a", F.col("n.b").alias("b"), F.col("n.d").alias("d"))


def mutual_nearest_match(points: DataFrame, targets: DataFrame, radius: float, by: list[str], id_col: str = "id", target_id: str = "id") -> DataFrame:
    """(by, a, b, d): pairs that are each other's nearest and within ``radius``.

    A nearer point than a partner within the radius is itself within it, so the cell join suffices.
    """
    near = pairs_within(points, targets, radius, by, id_col, target_id)
    first = lambda side, other: F.row_number().over(Window.partitionBy(*by, side).orderBy("d", other))
    return near.withColumns({"ra": first("a", "b"), "rb": first("b", "a")}).filter("ra = 1 AND rb = 1").select(*by, "a", "b", "d")


def rank_in_side(edges: DataFrame, by: list[str]) -> DataFrame:
    """``edges`` with ra and rb, their ranks among the edges of either end by (d, a, b)."""
    order = ["d", "a", "b"]
    return edges.withColumns({"ra": F.row_number().over(Window.partitionBy(*by, "a").orderBy(*order)), "rb": F.row_number().over(Window.partitionBy(*by, "b").orderBy(*order))})


def greedy_match(edges: DataFrame, by: list[str], most: int = Q.MOST_EDGES) -> DataFrame:
    """(by, a, b, d): the one-to-one matching that takes edges by (d, a, b) while both ends are free.

    Components of the edges are matched each in its task; those of more than ``most`` edges in rounds,
    which take every edge that is first for both its ends and drop the edges that they touch.
    """
    cols = [*by, "a", "b", "d"]
    small, large = Q.split_by_component(edges.select(*cols), F.xxhash64(F.lit(0), *by, "a"), F.xxhash64(F.lit(1), *by, "b"), most)
    taken = stash(Q.apply_in_order(small, ["d", "a", "b"], ["a", "b", "d", *by], Q.matching).select(*cols), "matched")
    left = stash(large, "edges") if large is not None else None
    while left is not None:
        first = stash(rank_in_side(left, by).filter("ra = 1 AND rb = 1").select(*cols), "first")
        if first.isEmpty():
            break
        taken = taken.unionByName(first)
        rest = stash(left.join(first.select(*by, "a"), [*by, "a"], "left_anti").join(first.select(*by, "b"), [*by, "b"], "left_anti"), "edges")
        discard(left)
        left = rest
    return taken


def greedy_match_nearest(points: DataFrame, targets: DataFrame, radius: float, by: list[str], id_col: str = "id", target_id: str = "id") -> DataFrame:
    """(by, a, b, d): each point offers its nearest target alone; the nearest offer of a target wins."""
    near = nearest_within(points, targets, radius, by, id_col, target_id)
    return near.groupBy(*by, "b").agg(F.min(F.struct("d", "a")).alias("n")).select(*by, F.col("n.a").alias("a"), "b", F.col("n.d").alias("d"))


def two_stage_match(points: DataFrame, clean: DataFrame, ignored: DataFrame, radius: float, by: list[str], id_col: str = "id", target_id: str = "id") -> DataFrame:
    """(by, a, b, d, stage): points matched to clean targets, and those left over to ignored ones."""
    one = stash(greedy_match(pairs_within(points, clean, radius, by, id_col, target_id), by), "clean")
    rest = points.join(one.select(*by, F.col("a").alias(id_col)), [*by, id_col], "left_anti")
    two = greedy_match(pairs_within(rest, ignored, radius, by, id_col, target_id), by)
    return one.withColumn("stage", F.lit(1)).unionByName(two.withColumn("stage", F.lit(2)))


def source_in_tile(sources: DataFrame, tiles: DataFrame, margin: float = 0.0) -> DataFrame:
    """Sources with each tile (name, x0, y0, size) that holds them, and local coordinates lx, ly.

    Tiles of one power of two share a grid, over whose cells they are spread and to which sources come, so that
    one large tile does not make the cells of all others large.
    """
    leveled = tiles.withColumn("__level", F.ceil(F.log2(F.greatest(F.col("size") + 2 * margin, F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect())  # as many as powers of two among the sizes
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("__level")))
    reach = lambda o: F.sequence(cell(F.col(o) - margin), cell(F.col(o) + F.col("size") + margin))
    spread = leveled.withColumn("__cx", F.explode(reach("x0"))).withColumn("__cy", F.explode(reach("y0")))
    placed = sources.withColumn("__level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumns({"__cx": cell(F.col("x")), "__cy": cell(F.col("y"))})
    joined = placed.join(spread, ["__level", "__cx", "__cy"])
    inside = lambda c, o: (F.col(c) >= F.col(o) - margin) & (F.col(c) < F.col(o) + F.col("size") + margin)
    return joined.filter(inside("x", "x0") & inside("y", "y0")).withColumns({"lx": F.col("x") - F.col("x0"), "ly": F.col("y") - F.col("y0")}).drop("__level", "__cx", "__cy")


def ellipse_pairs(sources: DataFrame, by: list[str], radius: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, s, t, d): pairs of ellipses as structs with s.id < t.id, within ``radius`` or, without one, with circles that touch.

    ``sources`` has source_id, x, y, a, b, theta and area; columns ``carry`` come along in the structs; sines are computed once a source. Without a radius ellipses meet by
    size: those whose axis is of one power of two share a grid, and smaller ones come to it, so that one
    large ellipse does not make the cells of all others large. Ellipses without finite axes meet none.
    """
    reach = F.greatest("a", "b")
    e = F.struct(F.col("source_id").alias("id"), "x", "y", "a", "b", "area", "theta", "__turn.cos", "__turn.sin", reach.alias("reach"), *carry)
    real = sources.filter(finite("x") & finite("y") & finite("a") & finite("b") & finite("theta"))
    rows = real.withColumn("__turn", turned("theta")).select(*by, e.alias("e"))
    if radius is not None:
        big = rows.withColumns({"level": F.lit(0), "width": F.lit(float(radius))})
        small = big
    else:
        leveled = rows.withColumn("level", F.ceil(F.log2(F.greatest(F.col("e.reach"), F.lit(0.0625)))).cast("int"))
        # As many numbers as there are powers of two among the axes.
        levels = sorted(r[0] for r in leveled.select("level").distinct().collect())
        width = F.pow(F.lit(2.0), F.col("level") + 1)
        big = leveled.withColumn("width", width)
        small = leveled.withColumnRenamed("level", "own").withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own")))) if levels else leveled.withColumn("own", F.col("level"))
        small = small.withColumn("width", width)
    # Cells are as wide as four limits: one side stands in its own, the other in all that its limit reaches, mostly one.
    cell = lambda c: F.floor(c / (4.0 * F.col("width")))
    reached = lambda c: F.sequence(cell(F.col(f"e.{c}") - 1.001 * F.col("width")), cell(F.col(f"e.{c}") + 1.001 * F.col("width")))
    spread = big.withColumn("cx", F.explode(reached("x"))).withColumn("cy", F.explode(reached("y")))
    left = spread.select(*by, "level", F.col("e").alias("l"), "cx", "cy")
    right = small.select(*by, "level", F.col("e").alias("r"), *([F.col("own")] if "own" in small.columns else []), cell(F.col("e.x")).alias("cx"), cell(F.col("e.y")).alias("cy"))
    both = left.join(right.hint("merge"), [*by, "level", "cx", "cy"])
    # Of one level a pair comes up from both sides.
    once = F.col("l.id") < F.col("r.id") if "own" not in small.columns else (F.col("own") < F.col("level")) | (F.col("l.id") < F.col("r.id"))
    dx, dy = F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")
    d = F.sqrt(dx * dx + dy * dy)
    limit = F.lit(float(radius)) if radius is not None else F.col("l.reach") + F.col("r.reach")
    first = F.col("l.id") < F.col("r.id")
    return both.filter(once).withColumn("d", d).filter(F.col("d") <= limit).select(*by, F.when(first, F.col("l")).otherwise(F.col("r")).alias("s"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("t"), "d")


def ellipse_overlap_join(sources: DataFrame, radius: float | None, by: list[str], points: list[tuple[float, float]] | None = None) -> DataFrame:
    """(by, a, b, d, in_a, in_b, iou, a_area, b_area) of pairs a < b: coverages of either by the other, and their IoU.

    Pairs are those of :func:`ellipse_pairs`. Pairs whose bounding circles are apart have no coverage.
    """
    points = points or unit_grid()
    near = F.col("d") <= F.col("s.reach") + F.col("t.reach")
    both = ellipse_pairs(sources, by, radius).withColumns({"in_b": F.when(near, coverage(points, F.col("s"), F.col("t"))).otherwise(0.0), "in_a": F.when(near, coverage(points, F.col("t"), F.col("s"))).otherwise(0.0)})
    both = both.select(*by, F.col("s.id").alias("a"), F.col("t.id").alias("b"), "d", "in_a", "in_b", F.col("s.area").alias("a_area"), F.col("t.area").alias("b_area"))
    shared = 0.5 * (F.col("in_b") * F.col("a_area") + F.col("in_a") * F.col("b_area"))
    union = F.col("a_area") + F.col("b_area") - shared
    return both.withColumn("iou", F.when(union > 0, F.least(F.greatest(F.try_divide(shared, union), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).select(*by, "a", "b", "d", "in_a", "in_b", "iou", "a_area", "b_area")


def close_pair_losers(sources: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """Ids of the fainter of each pair within ``radius``, ties by larger area, then the later row: free of order."""
    mag = F.when(F.isnan("mag") | F.col("mag").isNull(), float("inf")).otherwise(F.col("mag"))
    both = close_pairs(sources.withColumn("mag", mag), radius, by, "source_id", ("mag", "area"))
    lose_a = (F.col("a_mag") > F.col("b_mag")) | ((F.col("a_mag") == F.col("b_mag")) & (F.col("a_area") >= F.col("b_area")))
    return both.select(F.when(lose_a, F.col("a")).otherwise(F.col("b")).alias("source_id")).distinct()


def ordered_removal(edges: DataFrame, order: list[str], most: int = Q.MOST_EDGES) -> DataFrame:
    """Ids removed when edges (a, b, loser, ...) act in ``order``, and an edge with a removed end does nothing."""
    return removing_edges(edges, order, most).select(F.col("loser").alias("id")).distinct()


def removing_edges(edges: DataFrame, order: list[str], most: int = Q.MOST_EDGES) -> DataFrame:
    """The edges (a, b, loser) that act in ``order``: those without an end that an earlier one removed.

    Components act each in its task; those of more than ``most`` edges in rounds, which decide the edges
    that are first among the undecided ones of both their ends.
    """
    small, large = Q.split_by_component(edges, F.col("a").cast("long"), F.col("b").cast("long"), most)
    acting = Q.apply_in_order(small, order, ["a", "b", "loser"], Q.removal)
    left = stash(large, "edges") if large is not None else None
    while left is not None:
        rank = lambda side: F.row_number().over(Window.partitionBy("__end").orderBy(*order))
        ends = left.select("*", F.explode(F.array("a", "b")).alias("__end")).withColumn("__r", rank("__end"))
        first = stash(ends.groupBy("a", "b").agg(F.max("__r").alias("r"), F.first("loser").alias("loser")).filter("r = 1").select("a", "b", "loser"), "first")
        if first.isEmpty():
            break
        acting = acting.unionByName(first)
        losers = first.select(F.col("loser").alias("id"))
        rest = left.join(first.select("a", "b"), ["a", "b"], "left_anti")
        rest = stash(rest.join(losers.select(F.col("id").alias("a")), "a", "left_anti").join(losers.select(F.col("id").alias("b")), "b", "left_anti").select(*edges.columns), "edges")
        discard(left)
        left = rest
    return acting


def containment_losers(overlaps: DataFrame, threshold: float, most: int = Q.MOST_EDGES) -> DataFrame:
    """Ids of the larger of pairs that hold ``threshold`` of the smaller; removed rows no longer act; pairs go by (a, b).

    ``overlaps``: what :func:`ellipse_overlap_join` gives. Pairs without two positive areas do nothing.
    """
    a_small = F.col("a_area") <= F.col("b_area")
    held = F.when(a_small, F.col("in_b")).otherwise(F.col("in_a"))
    real = finite("a_area") & finite("b_area") & (F.col("a_area") > 0) & (F.col("b_area") > 0)
    # Coverages are worked out once, before the filter names them.
    marked = stash(overlaps.select("a", "b", F.when(a_small, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(real, held).alias("held")), "held")
    return ordered_removal(marked.filter(F.col("held") >= threshold).drop("held"), ["a", "b"], most)


def yielding_points(pairs: DataFrame, most: int = Q.MOST_EDGES) -> DataFrame:
    """(a, keep, d): points that lose to a kept one before them, and the first such; ``pairs``: later, earlier, kl, ke (their places in the order), d.

    The greedy choice in the order: component by component in tasks; in components of more than ``most``
    pairs by rounds, in which a point all of whose undecided neighbours come later is kept, and its
    neighbours lose.
    """
    small, large = Q.split_by_component(pairs, F.col("later").cast("long"), F.col("earlier").cast("long"), most)
    lost = Q.apply_in_order(small, ["kl", "ke"], ["later", "earlier", "d"], Q.yielding).select(F.col("later").alias("a"), F.col("earlier").alias("keep"), "d")
    if large is None:
        return lost
    large = stash(large, "large")
    left, gone = large, None
    while True:
        # Kept: who is later than nobody that is undecided.
        kept = left.select(F.col("earlier").alias("id")).distinct().join(left.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
        out = stash(left.join(kept.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("g")).distinct(), "lost")
        if out.isEmpty():
            break
        gone = out if gone is None else gone.unionByName(out)
        decided = out.unionByName(kept.select(F.col("id").alias("g")))
        rest = stash(left.join(decided, left["later"] == decided["g"], "left_anti").join(decided, left["earlier"] == decided["g"], "left_anti"), "pairs")
        if left is not large:
            discard(left)
        left = rest
    if gone is None:
        return lost
    # Which one a point loses to is known when all are decided.
    to_kept = large.join(gone.withColumnRenamed("g", "earlier"), "earlier", "left_anti").groupBy("later").agg(F.min(F.struct("ke", "earlier", "d")).alias("k"))
    return lost.unionByName(to_kept.select(F.col("later").alias("a"), F.col("k.earlier").alias("keep"), F.col("k.d").alias("d")))


def priority_dedup(points: DataFrame, radius: float, by: list[str], order: list[Column], most: int = Q.MOST_EDGES) -> DataFrame:
    """(a, keep, d): points that lose to a kept one within ``radius`` and come after it in ``order``; ties of the order go by id."""
    keyed = points.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("source_id").alias("id")))
    pairs = pairs_within(keyed, keyed, radius, by, "source_id", "source_id", ("__key",)).select(F.col("a").alias("later"), F.col("b").alias("earlier"), "d", F.col("a___key").alias("kl"), F.col("b___key").alias("ke")).filter("ke < kl")
    return yielding_points(pairs, most)


def sweep_losers(edges: DataFrame, gone_still_act: bool = False, most: int = Q.MOST_EDGES) -> DataFrame:
    """Ids removed when each point, in order, goes through its edges to later points, unless it is gone when its turn comes.

    ``edges``: a, b, ka, kb (places in the order, ka < kb) and loser. A point that goes during its own turn
    finishes it. Edges to points that are gone do nothing, or act with ``gone_still_act``. A point is gone
    at its turn if an edge of an earlier point with a turn removed it, so those are the points that yield;
    after that every edge can be decided by itself.
    """
    edges = stash(edges.select("a", "b", "ka", "kb", "loser"), "edges")
    forward = edges.filter("loser = b").select(F.col("b").alias("later"), F.col("a").alias("earlier"), F.col("kb").alias("kl"), F.col("ka").alias("ke"), F.lit(0.0).alias("d"))
    lost = stash(yielding_points(forward, most), "lost")
    own = edges.filter("loser = a").join(lost.select("a"), "a", "left_anti")
    if not gone_still_act:
        # The later end must not have gone before.
        places = edges.select(F.col("a").alias("keep"), F.col("ka").alias("since")).distinct()
        before = lost.select(F.col("a").alias("b"), "keep").join(places, "keep").select("b", "since")
        own = own.join(before, "b", "left").filter(F.col("since").isNull() | ~(F.col("since") < F.col("ka")))
    return lost.select(F.col("a").alias("id")).unionByName(own.select(F.col("a").alias("id"))).distinct()


def cluster_sources(sources: DataFrame, by: list[str], iou: float, area_cap: float, distance: float | None = None) -> DataFrame:
    """(source_id, cluster): components of pairs whose pixel-counted IoU is at least ``iou``; others alone.

    Only sources with areas below a cap link, and only within ``distance`` where there is one.
    """
    pairs = ellipse_pairs(sources.filter(F.col("area") < area_cap), by, distance)
    near = pairs.filter(F.col("d") <= F.col("s.reach") + F.col("t.reach"))
    edges = near.withColumn("iou", pixel_iou(F.col("s"), F.col("t"))).filter(F.col("iou") >= iou).select(F.col("s.id").alias("a"), F.col("t.id").alias("b"))
    found = connected_components(edges).withColumnRenamed("id", "source_id")
    return sources.select("source_id").join(found, "source_id", "left").select("source_id", F.coalesce("component", "source_id").alias("cluster"))


def band_link(points: DataFrame, bands: list[str], radius: float, by: list[str]) -> DataFrame:
    """(id, object, reference): mutual nearest neighbours of adjacent bands chained into objects.

    ``points`` has id, band, x, y and unique ids. The reference member is the one in the third band, else the first band's.
    """
    edges = None
    for one, two in zip(bands, bands[1:], strict=False):
        m = mutual_nearest_match(points.filter(F.col("band") == one), points.filter(F.col("band") == two), radius, by).select("a", "b")
        edges = m if edges is None else edges.unionByName(m)
    found = points.select("id", "band").join(connected_components(edges), "id", "left").withColumn("object", F.coalesce("component", "id"))
    place = F.array_position(F.array(*map(F.lit, bands)), F.col("band"))
    rank = F.row_number().over(Window.partitionBy("object").orderBy(F.when(place == 3, 0).otherwise(place), "id"))
    return found.withColumn("reference", rank == 1).select("id", "object", "reference")


def merge_close_by_score(points: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """The best-scored point of each group that distances below ``radius`` connect."""
    edges = close_pairs(points, radius, by).filter(F.col("d") < radius)
    found = points.join(connected_components(edges.select("a", "b")).select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return found.groupBy("component").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"), F.count("*").alias("members")).select("id", "members")


def parent_child_cascade(df: DataFrame, failed: Column) -> DataFrame:
    """Rows left after failed ones go, then children of failed parents, then parents without children; n_child is recounted."""
    bad = df.filter(failed).select(F.col("source_id").alias("parent"))
    rest = df.filter(~failed).join(bad, "parent", "left_anti")
    counts = rest.filter("parent <> 0").groupBy("parent").agg(F.count("*").alias("__n")).withColumnRenamed("parent", "source_id")
    out = rest.join(counts, "source_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return out.filter(~((F.col("n_child") > 0) & (F.col("__n") == 0))).withColumn("n_child", F.when(F.col("n_child") > 0, F.col("__n")).otherwise(F.lit(0)).cast("int")).drop("__n")


def replay_check(stored: DataFrame, fresh: DataFrame, key: str, equal: list[str], close: dict[str, float]) -> DataFrame:
    """(key, problem): ids missing on a side or repeated, and columns that differ by more than their tolerance."""
    s, f = (df.select(key, *equal, *close) for df in (stored, fresh))
    twice = s.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("problem"))
    j = s.select(F.col(key).alias("ks"), *[F.col(c).alias(f"s_{c}") for c in [*equal, *close]]).join(f.select(F.col(key).alias("kf"), *[F.col(c).alias(f"f_{c}") for c in [*equal, *close]]), F.col("ks") == F.col("kf"), "full")
    both = F.col("ks").isNotNull() & F.col("kf").isNotNull()
    found = [F.when(F.col("kf").isNull(), "missing"), F.when(F.col("ks").isNull(), "extra")]
    found += [F.when(both & ~F.col(f"s_{c}").eqNullSafe(F.col(f"f_{c}")), c) for c in equal]
    found += [F.when(both & (F.abs(F.col(f"s_{c}") - F.col(f"f_{c}")) > tol), c) for c, tol in close.items()]
    return j.select(F.coalesce("ks", "kf").alias(key), F.explode(F.array_compact(F.array(*found))).alias("problem")).unionByName(twice)


def flagged_matches(predictions: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """``predictions`` with matched: whether a kept target has their keys."""
    hit = kept.select(*keys, F.lit(True).alias("matched")).distinct()
    return predictions.join(hit, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def brightest_member(df: DataFrame, group: str, flux: str, id_col: str = "source_id") -> DataFrame:
    """(group, id_col): of each group the member with the most flux; ties by the least id."""
    return df.groupBy(group).agg(F.min_by(id_col, F.struct(-F.col(flux), F.col(id_col))).alias(id_col))


def isolated_flag(sources: DataFrame, by: list[str], iou: float = 0.05) -> DataFrame:
    """(source_id, isolated): whether no other ellipse overlaps a source by more than ``iou``; all pairs that touch are looked at."""
    o = ellipse_overlap_join(sources, None, by).filter(F.col("iou") > iou)
    crowded = o.select(F.explode(F.array("a", "b")).alias("source_id")).distinct().withColumn("__over", F.lit(True))
    return sources.select("source_id").join(crowded, "source_id", "left").select("source_id", F.col("__over").isNull().alias("isolated"))
