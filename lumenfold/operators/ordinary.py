"""Labels of ordinary sources by the rules of three surveys: clean, weak, strict or ignore, each with a reason.

Rules act in a fixed order and a label only falls. Rules on pairs of ellipses measure each pair once; where
what a rule does hangs on what it did before, the pairs act in their order, component by component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import finite
from lumenfold.operators import joins as J
from lumenfold.operators import rules as R
from lumenfold.operators.ellipses import area_share, pixel_iou, rim_share
from lumenfold.session import discard, ship_package, stash

C = F.col


@dataclass(frozen=True)
class CosmosPolicy:
    """Limits for a catalog with warning categories and model photometry."""

    warn_ignore: tuple[int, ...] = (1, 4, 5, 6)
    center_diff: float = 1.0
    ignore_diff: float = 2.0
    containment: float = 0.995
    fill_mag: float = 25.5
    fill_least: float = 0.1
    snr: tuple[float, float] = (5.0, 7.0)


@dataclass(frozen=True)
class A2744Policy:
    """Limits for a crowded field with enumerated flags."""

    fwhm: float = 2.0
    containment: float = 0.8
    iou: float = 0.8
    #: Width and height of the image, which pixels of overlaps must lie in.
    frame: tuple[int, int] | None = None
    flag_ignore: tuple[int, ...] = (16, 17, 18, 19)
    #: Flags in the order of their rank: of nested sources with flags of other ranks the parent of a lower one goes.
    ranks: tuple[tuple[int, int], ...] = ((0, 3), (2, 2), (1, 1), (3, 1))
    aperture_mag: float | None = None
    star_overlap: float = 0.35
    star_mag: float = 24.0
    snr: tuple[float, float] = (5.0, 7.0)


def valid_ellipse() -> Column:
    """Whether place, axes, angle and area are finite, and axes and area positive."""
    known = [finite(c) for c in ("x", "y", "a", "b", "theta", "area")]
    out = known[0]
    for k in known[1:]:
        out = out & k
    return F.coalesce(out & (C("a") > 0) & (C("b") > 0) & (C("area") > 0), F.lit(False))


def lowered(df: DataFrame, when: Column, cls: str | Column, why: str | Column) -> DataFrame:
    """``df`` with its label lowered to ``cls`` where the rule holds and the label is higher."""
    new = F.struct((F.lit(cls) if isinstance(cls, str) else cls).alias("class"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    return df.withColumn("label", F.when(F.coalesce(when, F.lit(False)), R.downgrade(C("label"), new)).otherwise(C("label")))


def started(df: DataFrame) -> DataFrame:
    """``df`` with a clean label, but for centres without data (a false ``center_ok``, if there is such a column)."""
    ok = F.coalesce(C("center_ok"), F.lit(False)) if "center_ok" in df.columns else F.lit(True)
    return lowered(df.withColumns({"label": F.struct(F.lit("clean").alias("class"), F.lit("").alias("reason")), "__seen": ok}), ~ok, "ignore", "center_no_data")


def retained() -> Column:
    return C("label.class") != "ignore"


def labels(df: DataFrame) -> DataFrame:
    return df.select("source_id", C("label.class").alias("class"), C("label.reason").alias("reason"))


def marked(df: DataFrame, ids: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """``df`` with the boolean ``name`` of the rows whose source_id is in ``ids``."""
    hit = ids.select(F.col(id_col).alias("source_id"), F.lit(True).alias(name)).distinct()
    return df.join(hit, "source_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def fainter_of_close(points: DataFrame, radius: float, by: list[str], most: int = J.Q.MOST_EDGES) -> DataFrame:
    """Ids lost when each source, in order of ids, goes through its later neighbours nearer than ``radius``: the fainter of two goes.

    Of equally bright ones the first goes. A source that goes during its turn finishes it, and neighbours that
    are gone still act. Sources without a finite place or magnitude take no part.
    """
    known = points.filter(finite("x") & finite("y") & finite("mag"))
    both = J.close_pairs(known, radius, by, "source_id", ("mag",)).filter(C("d") < radius)
    edges = both.select("a", "b", C("a").alias("ka"), C("b").alias("kb"), F.when(C("a_mag") >= C("b_mag"), C("a")).otherwise(C("b")).alias("loser"))
    return J.sweep_losers(edges, gone_still_act=True, most=most)


def brighter_of_close(points: DataFrame, radius: float, by: list[str], most: int = J.Q.MOST_EDGES) -> DataFrame:
    """Ids lost pair by pair, in order of ids, at most ``radius`` apart: the first where it is brighter, else the second; pairs with a lost end do nothing."""
    both = J.close_pairs(points.filter(finite("x") & finite("y")), radius, by, "source_id", ("mag",))
    first = finite("a_mag") & (F.isnan("b_mag") == F.lit(False)) & C("b_mag").isNotNull() & (C("a_mag") < C("b_mag"))
    return J.ordered_removal(both.select("a", "b", F.when(F.coalesce(first, F.lit(False)), C("a")).otherwise(C("b")).alias("loser")), ["a", "b"], most)


def _before(x1: Column, id1: Column, x2: Column, id2: Column) -> Column:
    """Whether the first of two points comes first by x, then by id."""
    return (x1 < x2) | ((x1 == x2) & (id1 < id2))


def _met_in_sweep(edges: DataFrame, points: DataFrame, by: list[str], width: float = 8.0) -> DataFrame:
    """``edges`` (by, a, b, right, bx) whose later end the sweep of the earlier one comes to.

    A sweep goes by x, then id, and ends at the first point that lies, by x alone, farther off than both
    radii; ``right`` is where the radius of a ends. Points between are looked up by columns of ``width``:
    of whole columns the furthest left end tells, and only in the last one points are met one by one.
    """
    column = lambda c: F.floor(c / width)
    spans = points.select(*by, C("source_id").alias("k"), C("x").alias("kx"), (C("x") - F.greatest("a", "b")).alias("left"), column(C("x")).alias("cx"))
    tops = spans.groupBy(*by, "cx").agg(F.max("left").alias("top"))
    last = edges.withColumn("cx", column(C("bx")))
    passed = edges.filter(column(C("right")) < column(C("bx"))).withColumn("cx", F.explode(F.sequence(column(C("right")), column(C("bx")) - 1)))
    ended = passed.join(tops, [*by, "cx"]).filter(C("top") > C("right")).select("a", "b")
    ended = ended.unionByName(last.join(spans, [*by, "cx"]).filter((C("left") > C("right")) & _before(C("kx"), C("k"), C("bx"), C("b"))).select("a", "b"))
    return edges.join(ended.distinct(), ["a", "b"], "left_anti")


def swept_containment(sources: DataFrame, by: list[str], share: float, most: int = J.Q.MOST_EDGES) -> DataFrame:
    """Ids of the larger of pairs that hold ``share`` of the smaller, measured on whole pixels, in a sweep by x.

    Each source that is not removed when its turn comes goes through the later ones that it meets, and finishes
    that even if it is removed meanwhile; removed ones are passed over. Of equal areas the later one is the larger.
    """
    rows = stash(sources.filter(valid_ellipse()), "active")
    first = _before(C("s.x"), C("s.id"), C("t.x"), C("t.id"))
    pairs = J.ellipse_pairs(rows, by).select(*by, F.when(first, C("s")).otherwise(C("t")).alias("p"), F.when(first, C("t")).otherwise(C("s")).alias("q"))
    p_small = C("p.area") <= C("q.area")
    held = F.when(p_small, area_share(C("q"), C("p"))).otherwise(area_share(C("p"), C("q")))
    place = lambda e: F.struct(C(f"{e}.x").alias("x"), C(f"{e}.id").alias("id"))
    edges = pairs.select(*by, C("p.id").alias("a"), C("q.id").alias("b"), place("p").alias("ka"), place("q").alias("kb"), F.when(p_small, C("q.id")).otherwise(C("p.id")).alias("loser"), (C("p.x") + C("p.reach")).alias("right"), C("q.x").alias("bx"), held.alias("held"))
    edges = stash(edges, "held").filter(C("held") >= share).drop("held")
    return J.sweep_losers(_met_in_sweep(edges, rows, by), most=most)


def label_ordinary_hsc(sources: DataFrame, by: list[str], narrow: Column, p: R.ClassPolicy = R.ClassPolicy()) -> DataFrame:
    """(source_id, class, reason): aperture against Kron, fill, flags, containment by a sweep, then signal-to-noise.

    A difference of exactly the limit is kept here, unlike in the classifier.
    """
    kept = R.at_most(F.abs(C("diff")), p.ap2_kron_max)
    s = lowered(started(sources), ~kept, "ignore", "ap2_kron")
    s = lowered(s, retained() & R.fill_center_only(C("area"), C("fill"), p), "strict", "fill_ratio")
    s = stash(lowered(s, (C("label.class") == "clean") & (C("f_edge") | C("f_bad")), "ignore", "flag"), "labels")
    s = stash(marked(s, swept_containment(s.filter("label.class = 'clean'"), by, p.containment), "held"), "labels")
    s = lowered(s, C("held"), "ignore", "containment")
    by_snr = R.snr_class(C("snr"), narrow, C("area"))
    s = lowered(s, (C("label.class") == "clean") & (by_snr == "ignore"), "ignore", "snr_ignore")
    return labels(lowered(s, (C("label.class") == "clean") & (by_snr == "weak_shape"), "weak", "snr_weak"))


def rim_containment(sources: DataFrame, by: list[str], share: float, most: int = J.Q.MOST_EDGES) -> DataFrame:
    """Ids of the larger of pairs with ``share`` of the smaller one's rim and centre in it; pairs act by ids, those with a removed end do nothing."""
    pairs = J.ellipse_pairs(sources.filter(valid_ellipse()), by)
    s_small = C("s.area") <= C("t.area")
    held = F.when(s_small, rim_share(C("t"), C("s"))).otherwise(rim_share(C("s"), C("t")))
    edges = stash(pairs.select(C("s.id").alias("a"), C("t.id").alias("b"), F.when(s_small, C("t.id")).otherwise(C("s.id")).alias("loser"), held.alias("held")), "held")
    return J.ordered_removal(edges.filter(C("held") >= share).drop("held"), ["a", "b"], most)


def label_ordinary_cosmos(sources: DataFrame, by: list[str], p: CosmosPolicy = CosmosPolicy()) -> DataFrame:
    """(source_id, class, reason): warning category, star mask, photometry, containment, fill of bright sources, signal-to-noise.

    ``sources`` also has warn, star_mask and model_mag. Only sources above the lower bound make a neighbour strict.
    """
    low, high = p.snr
    s = lowered(started(sources), ~valid_ellipse(), "ignore", "invalid_geometry")
    s = lowered(s, C("warn").isin(*p.warn_ignore), "ignore", "warn")
    s = lowered(s, retained() & C("star_mask"), "strict", "star_mask")
    good = R.below(C("mag"), 90.0) & R.below(C("model_mag"), 90.0)
    diff = F.abs(C("mag") - C("model_mag"))
    s = lowered(s, retained() & (~good | (diff > p.ignore_diff)), "ignore", "photometry")
    s = stash(lowered(s, retained() & (diff >= p.center_diff), "strict", "photometry"), "labels")
    s = stash(marked(s, rim_containment(s.filter(retained() & R.above(C("snr"), low)), by, p.containment), "held"), "labels")
    s = lowered(s, C("held"), "strict", "containment")
    s = lowered(s, retained() & R.below(C("mag"), p.fill_mag) & R.at_least(C("fill"), 0.0) & R.below(C("fill"), p.fill_least), "strict", "low_fill")
    s = lowered(s, retained() & ~R.above(C("snr"), low), "ignore", "snr_ignore")
    return labels(lowered(s, retained() & R.below(C("snr"), high), "strict", "snr_strict"))


#: Angles, and radii in units of the axes, at which a footprint is looked up.
FOOTPRINT_ANGLES, FOOTPRINT_RADII = 48, (0.5, 1.0)


#: Fixed value: the side of a tile of a mask, whose rows are the bits of a long.
MASK_TILE = 64


def _bitmaps(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tx, ty, rows): tiles of ``mask`` (keys, x, y) with pixels that are on, as structs of a row r and its bits."""
    at = mask.select(*keys, C("x").cast("long").alias("x"), C("y").cast("long").alias("y"))
    tile = lambda c: F.floor(C(c) / float(MASK_TILE)).alias(f"t{c}")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(x, {MASK_TILE}) AS INT))")
    rows = at.groupBy(*keys, tile("x"), tile("y"), F.pmod("y", F.lit(MASK_TILE)).cast("int").alias("r")).agg(F.bit_or(bit).alias("bits"))
    return rows.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct("r", "bits")).alias("rows"))


def _reached_tiles(places: list[tuple[float, float, int]], frame: tuple[int, int]) -> Column:
    """Tiles (tx, ty) of the frame that a footprint may have places in: those of its box or, of large ones, those of its places."""
    side, reach = float(MASK_TILE), F.greatest("a", "b") + 1.0
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(most - 1.0))
    tile = lambda v, most: F.floor(within(v, most) / side)
    span = lambda c, most: F.sequence(tile(C(c) - reach, most), tile(C(c) + reach, most))
    box = F.flatten(F.transform(span("x", frame[0]), lambda tx: F.transform(span("y", frame[1]), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))
    grid = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v, _ in places])
    c, s = F.cos("theta"), F.sin("theta")
    at = F.transform(grid, lambda g: F.struct(F.rint(C("x") + c * C("a") * g["u"] - s * C("b") * g["v"]).alias("px"), F.rint(C("y") + s * C("a") * g["u"] + c * C("b") * g["v"]).alias("py")))
    on_frame = F.filter(at, lambda q: (q["px"] >= 0) & (q["px"] < frame[0]) & (q["py"] >= 0) & (q["py"] < frame[1]))
    own = F.array_distinct(F.transform(on_frame, lambda q: F.struct(F.floor(q["px"] / side).alias("tx"), F.floor(q["py"] / side).alias("ty"))))
    return F.when(reach <= side, box).otherwise(own)


def footprint_share(sources: DataFrame, mask: DataFrame, keys: list[str], frame: tuple[int, int]) -> DataFrame:
    """(source_id, share, center): of places in each ellipse the share that is on in ``mask`` (keys, x, y), and whether its centre is.

    Places are the centre, as often as there are angles, and those at two radii; each counts by its nearest pixel, halves
    to even, and only inside the frame (width, height). Ellipses that are not valid, or have no place that is on, have no
    row. An ellipse goes to the tiles of the mask that it reaches, mostly one, and its places are looked up in their
    bits, so that no place travels by itself.
    """
    ship_package(sources.sparkSession)
    turn = [2 * math.pi * i / FOOTPRINT_ANGLES for i in range(FOOTPRINT_ANGLES)]
    places = [(0.0, 0.0, FOOTPRINT_ANGLES)] + [(r * math.cos(t), r * math.sin(t), 1) for r in FOOTPRINT_RADII for t in turn]
    u, v, weight = (np.array(c) for c in zip(*places, strict=True))
    side, (width, height) = MASK_TILE, frame
    fields = ("x", "y", "a", "b", "cos", "sin")
    rows = sources.filter(valid_ellipse()).withColumn("t", F.explode(_reached_tiles(places, frame)))
    rows = rows.select(*keys, "source_id", *[C(c).cast("double").alias(c) for c in ("x", "y", "a", "b")], F.cos("theta").alias("cos"), F.sin("theta").alias("sin"), "t.tx", "t.ty")
    met = rows.join(_bitmaps(mask, keys).hint("merge"), [*keys, "tx", "ty"]).select("source_id", *fields, "tx", "ty", "rows")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n, b=batch: b.column(n).to_numpy(zero_copy_only=False)
            x, y, a, b, cos, sin, tx, ty = (column(n)[:, None] for n in (*fields, "tx", "ty"))
            lists = batch.column("rows")
            lit, bits, at = np.zeros((len(batch), side), np.uint64), lists.flatten(), np.arange(len(batch))
            lit[np.repeat(at, lists.value_lengths().to_numpy()), bits.field("r").to_numpy()] = bits.field("bits").to_numpy().view(np.uint64)
            px, py = np.rint(x + cos * a * u - sin * b * v), np.rint(y + sin * a * u + cos * b * v)
            inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
            px, py = (np.where(inside, c, 0.0).astype(np.int64) for c in (px, py))
            here = inside & (px // side == tx) & (py // side == ty)
            on = here & ((lit[at[:, None], py % side] >> (px % side).astype(np.uint64)) & np.uint64(1)).astype(bool)
            found = on.any(1)
            made = {"source_id": batch.column("source_id").filter(pa.array(found)), "n": pa.array((inside * weight).sum(1)[found]), "on": pa.array((on * weight).sum(1)[found]), "center": pa.array(on[found, 0])}
            yield pa.RecordBatch.from_pydict(made)

    hit = met.mapInArrow(work, T.StructType([met.schema["source_id"], *T.StructType.fromDDL("n long, on long, center boolean").fields]))
    sums = hit.groupBy("source_id").agg(F.max("n").alias("n"), F.sum("on").alias("on"), F.bool_or("center").alias("center"))
    return sums.select("source_id", (C("on") / C("n")).alias("share"), "center")


def _nested_pairs(s: DataFrame, by: list[str], p: A2744Policy) -> DataFrame:
    """(a, b, a_area, b_area, iou, in_a, in_b) of all pairs of valid ellipses that touch; in_a is the share of b in a."""
    pairs = J.ellipse_pairs(s.filter(valid_ellipse()), by)
    found = pairs.select(C("s.id").alias("a"), C("t.id").alias("b"), C("s.area").alias("a_area"), C("t.area").alias("b_area"), pixel_iou(C("s"), C("t"), None, p.frame).alias("iou"), area_share(C("s"), C("t")).alias("in_a"), area_share(C("t"), C("s")).alias("in_b"))
    return stash(found, "pairs")


def nested_labels(pairs: DataFrame, s: DataFrame, p: A2744Policy, most: int = J.Q.MOST_EDGES) -> DataFrame:
    """(source_id, class, reason): what overlaps and containment lower, by ranks of flags; ``s``: source_id, mag, warn, flagged, label.

    Pairs act by ids while both ends are usable: not ignored, or ignored for their flag alone. Of pairs that
    nearly coincide the flagged, else the fainter (of equal ones the first) goes. Of nested ones the parent goes
    if its flag ranks below the child's; it is strict if the child is flagged; else the child is weak and
    the parent weak or, of equal ranks, strict. Sources with flags without a rank are weak at most. Which
    ends are usable only falls, by the pairs that remove one, so these are decided first, in their order,
    and every other pair acts unless an end went before its turn: one pass reaches the fixed point.
    """
    rank = F.create_map(*[F.lit(x) for kv in p.ranks for x in kv])
    about = s.filter(retained() | C("flagged")).select("source_id", "mag", "flagged", F.when(C("flagged"), -1).otherwise(F.coalesce(F.try_element_at(rank, C("warn").cast("int")), F.lit(0))).alias("rank"), F.coalesce(C("warn").isin(*[f for f, _ in p.ranks]), F.lit(False)).alias("ranked"))
    side = lambda e: about.select(C("source_id").alias(e), F.struct("mag", "flagged", "rank", "ranked").alias(f"{e}_"))
    both = pairs.filter(f"iou >= {p.iou} OR in_a >= {p.containment} OR in_b >= {p.containment}").join(side("a"), "a").join(side("b"), "b").filter(~(C("a_.flagged") & C("b_.flagged")))
    same = C("iou") >= p.iou
    fainter = F.when(C("a_.flagged"), C("a")).when(C("b_.flagged"), C("b")).when(C("a_.mag") >= C("b_.mag"), C("a")).otherwise(C("b"))
    a_large = (C("in_a") >= p.containment) & ((C("a_area") >= C("b_area")) | (C("in_b") < p.containment))
    pick = lambda one, two: F.when(C("a_large"), one).otherwise(two)
    both = both.withColumns({"same": same, "a_large": a_large}).withColumns({"large": pick(C("a"), C("b")), "small": pick(C("b"), C("a")), "large_": pick(C("a_"), C("b_")), "small_": pick(C("b_"), C("a_"))})
    both = both.withColumn("loser", F.when(C("same"), fainter).when(C("large_.rank") < C("small_.rank"), C("large")))
    # What is flagged is ignored already, and still acts after.
    flagged = F.when(C("loser") == C("a"), C("a_.flagged")).otherwise(C("b_.flagged"))
    edges = stash(both.select("a", "b", "same", "large", "small", "large_", "small_", "loser", (C("loser").isNotNull() & ~flagged).alias("removes")), "edges")
    acting = stash(J.removing_edges(edges.filter("removes").select("a", "b", "loser"), ["a", "b"], most), "removing")
    went = acting.select(C("loser").alias("id"), F.struct("a", "b").alias("went"))
    rest = edges.filter("loser IS NULL")
    for e in ("a", "b"):
        rest = rest.join(went.select(C("id").alias(e), C("went").alias(f"{e}_went")), e, "left").filter(C(f"{e}_went").isNull() | ~(C(f"{e}_went") < F.struct("a", "b"))).drop(f"{e}_went")
    effect = lambda target, cls, why: F.struct(target.alias("source_id"), cls.alias("class"), F.lit(why).alias("reason"))
    weak, strict = F.lit("weak"), F.lit("strict")
    parent = F.when(~C("large_.ranked"), weak).when(C("large_.rank") > C("small_.rank"), weak).otherwise(strict)
    mutual = F.array(effect(C("large"), parent, "containment_candidate"), effect(C("small"), weak, "containment_candidate"))
    mild = rest.select("a", "b", F.explode(F.when(C("small_.flagged"), F.array(effect(C("large"), strict, "contains_ignore"))).otherwise(mutual)).alias("e"))
    hard = acting.join(edges.select("a", "b", "same"), ["a", "b"]).select("a", "b", F.struct(C("loser").alias("source_id"), F.lit("ignore").alias("class"), F.when(C("same"), "high_iou").otherwise("low_priority_parent").alias("reason")).alias("e"))
    order = F.create_map(*[F.lit(x) for kv in R.RANKS.items() for x in kv])
    every = mild.unionByName(hard).select("a", "b", "e.*").withColumn("level", order[C("class")])
    found = stash(every.groupBy("source_id").agg(F.min_by(F.struct("class", "reason"), F.struct("level", "a", "b")).alias("n")).select("source_id", "n.class", "n.reason"), "nested")
    discard(edges, acting)
    return found


def _holds(pairs: DataFrame, p: A2744Policy) -> DataFrame:
    """(outer, inner): ellipses that hold one of at most their area."""
    holds = pairs.filter(f"in_a >= {p.containment} AND a_area >= b_area").select(C("a").alias("outer"), C("b").alias("inner"))
    return holds.unionByName(pairs.filter(f"in_b >= {p.containment} AND b_area >= a_area").select(C("b").alias("outer"), C("a").alias("inner")))


def _holders(s: DataFrame, holds: DataFrame, *carry: Column) -> tuple[DataFrame, DataFrame]:
    """``holds`` of usable outer sources, with ``carry``, and (inner): the ignored sources."""
    usable = s.filter(C("__seen") & C("label.class").isin("clean", "weak")).select(C("source_id").alias("outer"), *carry)
    return holds.join(usable, "outer"), s.filter(C("__seen") & ~retained()).select(C("source_id").alias("inner"))


def _protected(s: DataFrame, holds: DataFrame) -> DataFrame:
    """``s`` in which usable sources that hold an ignored one are strict."""
    edges, ignored = _holders(s, holds)
    hit = edges.join(ignored, "inner", "left_semi").select(C("outer").alias("id"))
    return lowered(marked(s, hit, "hit"), C("hit"), "strict", "contains_ignore").drop("hit")


def _protected_in_turns(s: DataFrame, holds: DataFrame) -> DataFrame:
    """``s`` after protection and the aperture rule in turns, until nothing changes; ``falls``: whether the rule ignores a strict source.

    Only a source that a turn makes strict can change by the rule, and what falls is all that the next turn
    starts from, so turns pass on these alone.
    """
    edges, ignored = _holders(s, holds, C("falls"))
    edges = stash(edges, "holders")
    hit = stash(edges.join(ignored, "inner", "left_semi").select("outer", "falls").distinct(), "hit")
    every = hit
    while not hit.filter("falls").isEmpty():
        fallen = hit.filter("falls").select(C("outer").alias("inner"))
        hit = stash(edges.join(fallen, "inner", "left_semi").select("outer", "falls").distinct().join(every.select("outer"), "outer", "left_anti"), "hit")
        every = every.unionByName(hit)
    discard(edges)
    s = lowered(marked(s, every, "hit", "outer"), C("hit"), "strict", "contains_ignore")
    return lowered(s, C("hit") & C("falls"), "ignore", "aperture_snr_ignore")


def _remeasured(s: DataFrame, p: A2744Policy) -> DataFrame:
    """``s`` after its measured ratios (ap_snr, trusted): strict sources need a known one, others are lowered by trusted ones alone."""
    low, high = p.snr
    tested = retained() if p.aperture_mag is None else retained() & R.above(C("mag"), p.aperture_mag)
    applies = tested & (F.coalesce(C("trusted"), F.lit(False)) | (C("label.class") == "strict"))
    s = s.withColumn("__applies", applies)
    s = lowered(s, C("__applies") & ~R.at_least(C("ap_snr"), low), "ignore", "aperture_snr_ignore")
    return lowered(s, C("__applies") & R.at_least(C("ap_snr"), low) & (C("ap_snr") < high), "strict", "aperture_snr_center").drop("__applies")


def label_ordinary_a2744(sources: DataFrame, by: list[str], p: A2744Policy = A2744Policy(), star_mask: DataFrame | None = None, frame: tuple[int, int] = (1, 1), measured: DataFrame | None = None, most: int = J.Q.MOST_EDGES) -> DataFrame:
    """(source_id, class, reason): flags, size of the PSF, close pairs, overlaps and containment, signal-to-noise, stars, apertures.

    ``sources``: source_id, x, y, a, b, theta, area, mag, snr and warn (the flag); center_ok where centres may lie on
    no data, and star_mask where hits are known. ``star_mask`` (by, x, y) are the pixels of stars in an image of the size
    ``frame``: faint sources whose centre or enough of whose places lie on them are ignored. ``measured``:
    source_id, snr and trusted of apertures. A usable source that holds an ignored one is strict. As strict ones
    need a known aperture ratio, that may ignore more, so protection and the aperture rule take turns until nothing changes:
    labels only fall, so that ends.
    """
    low, high = p.snr
    shape = ["x", "y", "a", "b", "theta", "area"]
    given = [c for c in ("center_ok", *(("star_mask",) if star_mask is None else ())) if c in sources.columns]
    s = lowered(started(sources.select(*by, "source_id", *shape, "mag", "snr", "warn", *given)), ~valid_ellipse(), "ignore", "invalid_geometry")
    s = s.withColumn("flagged", F.coalesce(C("__seen") & valid_ellipse() & C("warn").isin(*p.flag_ignore), F.lit(False)))
    s = lowered(s, C("flagged"), "ignore", "flag")
    placed = stash(lowered(s, retained() & ((C("a") < p.fwhm) | (C("b") < p.fwhm)), "ignore", "psf_size").drop("center_ok"), "labels")
    pairs = _nested_pairs(placed.filter("__seen"), by, p)
    holds = stash(_holds(pairs, p), "holds")
    # Ellipses end here: what comes after goes by ids, and passes on labels and the few columns that rules look at.
    s = marked(placed.drop(*shape, *by), brighter_of_close(placed.filter(retained()), p.fwhm, by, most), "close")
    s = lowered(s, C("close"), "ignore", "close_brighter").drop("close")
    faint = R.at_least(C("mag"), p.star_mag)
    if star_mask is not None:
        # Labels only fall, so what is ignored before stars are looked at is left as it is.
        hits = footprint_share(placed.filter(retained() & faint), star_mask, by, frame)
        s = marked(s, hits.filter(C("center") | (C("share") >= p.star_overlap)), "__star", "source_id")
    else:
        s = s.withColumn("__star", C("star_mask") if "star_mask" in s.columns else F.lit(False)).drop("star_mask")
    if measured is not None:
        s = s.join(measured.select("source_id", C("snr").alias("ap_snr"), "trusted"), "source_id", "left")
    first = stash(s, "labels")
    discard(placed)
    # Protection makes strict what was usable, so that the next rule sees the same sources before and after.
    found = nested_labels(pairs, first, p, most)
    discard(pairs)
    s = _protected(first, holds).join(found.select("source_id", C("class").alias("new_class"), C("reason").alias("new_reason")), "source_id", "left")
    s = lowered(s, C("new_class").isNotNull(), C("new_class"), C("new_reason")).drop("new_class", "new_reason", "warn", "flagged")
    s = lowered(s, retained() & ~R.at_least(C("snr"), low), "ignore", "snr_ignore")
    s = lowered(s, retained() & (C("snr") < high), "weak", "snr_weak")
    second = stash(lowered(s, C("__star") & faint, "ignore", "star_mask").drop("__star", "snr"), "labels")
    discard(first, found)
    s = _protected(second, holds)
    if measured is None:
        return labels(s)
    tested = F.lit(True) if p.aperture_mag is None else R.above(C("mag"), p.aperture_mag)
    third = stash(_remeasured(s, p).withColumn("falls", tested & ~R.at_least(C("ap_snr"), low)).select("source_id", "label", "__seen", "falls"), "labels")
    discard(second)
    return labels(_protected_in_turns(third, holds))
