"""Ellipses on whole pixels by row spans, and measures of pairs of ellipses.

An ellipse is a struct of x, y, a, b, cos, sin and reach. In a pixel row it covers one interval, whose ends
a quadratic equation gives, so counts over pixels are sums of interval lengths over rows. A pixel
whose centre lies on the rim counts as inside: the one tolerance for that is ``RIM``. Measures of pairs are
NumPy over Arrow batches, by the same arithmetic as columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a pixel's squared distance in units of the axes may exceed 1 by.
RIM = 1e-9
#: Axes count as so much at least.
THIN = 1e-6
#: Pixel rows of pairs that are counted in one step.
ROWS_AT_ONCE = 1 << 18


def shape(x: Column, y: Column, a: Column, b: Column, theta: Column) -> Column:
    """The struct of an ellipse from its columns."""
    return F.struct(x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b"), F.cos(theta).alias("cos"), F.sin(theta).alias("sin"), F.greatest(a, b).alias("reach"))


def rows_of(e: Column) -> Column:
    """What tells the span of an ellipse in a pixel row: x, y, slope, top and bend.

    In the row that lies dy from the centre the ellipse covers x - slope dy, give or take the root of top - bend dy dy.
    """
    a, b = F.greatest(e["a"], F.lit(THIN)), F.greatest(e["b"], F.lit(THIN))
    p = e["cos"] * e["cos"] / (a * a) + e["sin"] * e["sin"] / (b * b)
    q = e["cos"] * e["sin"] * (1.0 / (a * a) - 1.0 / (b * b))
    return F.struct(e["x"].alias("x"), e["y"].alias("y"), (q / p).alias("slope"), ((1.0 + RIM) / p).alias("top"), (1.0 / (a * b * p * (a * b * p))).alias("bend"))


def _counts(s: Column, t: Column, box: list[Column]) -> Column:
    """The struct of the numbers of grid places inside ``s``, inside ``t`` and inside both, row by row; ``box``: x0, x1, y0, y1, step."""
    rim, thin, at_once = RIM, THIN, ROWS_AT_ONCE

    @F.arrow_udf("s long, t long, both long")
    def count(one: pa.Array, two: pa.Array, places: pa.Array) -> pa.Array:
        def shaped(e):
            x, y, a, b, cos, sin = (e.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "a", "b", "cos", "sin"))
            a, b = np.fmax(a, thin), np.fmax(b, thin)
            p = cos * cos / (a * a) + sin * sin / (b * b)
            q = cos * sin * (1.0 / (a * a) - 1.0 / (b * b))
            return x, y, q / p, (1.0 + rim) / p, 1.0 / (a * b * p * (a * b * p))

        def spans(e, i, y, x0, x1, step):
            """Numbers of the first and last grid place of each row that an ellipse covers, 1 and 0 where there are none."""
            x, cy, slope, top, bend = (v[i] for v in e)
            dy = y - cy
            mid, half = x - slope * dy, np.sqrt(top - bend * dy * dy)
            none = np.isnan(mid - half)
            first = np.maximum(0.0, np.ceil((mid - half - x0) / step))
            last = np.floor((np.minimum(mid + half, x1) - x0) / step)
            return np.where(none, 1.0, first), np.where(none, 0.0, last)

        us, vs = shaped(one), shaped(two)
        x0, x1, y0, y1, step = (places.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        rows = np.where(y0 <= y1, (y1 - y0) // step + 1, 0)
        out = np.zeros((3, len(rows)), np.int64)
        upto = np.concatenate([[0], np.cumsum(rows)])
        begin = 0
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + at_once, "right")) - 1)
            i = np.repeat(np.arange(begin, end), rows[begin:end])
            y = (y0[i] + (np.arange(len(i)) - (upto[i] - upto[begin])) * step[i]).astype(np.float64)
            grid = y, x0[i], x1[i].astype(np.float64), step[i]
            (sf, sl), (tf, tl) = spans(us, i, *grid), spans(vs, i, *grid)
            for k, (f, l) in enumerate([(sf, sl), (tf, tl), (np.maximum(sf, tf), np.minimum(sl, tl))]):
                out[k, begin:end] = np.bincount(i - begin, np.maximum(0.0, l - f + 1), end - begin).astype(np.int64)
            begin = end
        return pa.StructArray.from_arrays([pa.array(n) for n in out], ["s", "t", "both"])

    return count(s, t, F.struct(*[c.cast("long").alias(n) for n, c in zip(("x0", "x1", "y0", "y1", "step"), box, strict=True)]))


def _step(x0: Column, x1: Column, y0: Column, y1: Column, most: int | None) -> Column:
    """Pixels between the places that are looked at, so that a side has ``most`` at most."""
    one = F.lit(1).cast("long")
    return one if most is None else F.greatest(one, F.ceil((F.greatest(x1 - x0, y1 - y0) + 1) / float(most)).cast("long"))


def _near(s: Column, t: Column) -> Column:
    dx, dy = s["x"] - t["x"], s["y"] - t["y"]
    return F.sqrt(dx * dx + dy * dy) <= s["reach"] + t["reach"]


def pixel_iou(s: Column, t: Column, most: int | None = 512, frame: tuple[int, int] | None = None) -> Column:
    """IoU of two ellipses counted on the pixels around both.

    Boxes of more than ``most`` pixels a side are sampled in steps; without ``most`` every pixel counts.
    ``frame`` (width, height) cuts what lies outside of it.
    """
    lo = lambda c: F.floor(F.least(s[c] - s["reach"], t[c] - t["reach"])).cast("long")
    hi = lambda c: F.ceil(F.greatest(s[c] + s["reach"], t[c] + t["reach"])).cast("long")
    x0, x1, y0, y1 = lo("x"), hi("x"), lo("y"), hi("y")
    if frame is not None:
        zero = F.lit(0).cast("long")
        x0, y0 = F.greatest(zero, x0), F.greatest(zero, y0)
        x1, y1 = F.least(F.lit(frame[0] - 1).cast("long"), x1), F.least(F.lit(frame[1] - 1).cast("long"), y1)
    c = _counts(s, t, [x0, x1, y0, y1, _step(x0, x1, y0, y1, most)])
    share = F.when(c["s"] + c["t"] > c["both"], c["both"] / (c["s"] + c["t"] - c["both"])).otherwise(0.0)
    return F.when(_near(s, t), share).otherwise(0.0)


def area_share(outer: Column, inner: Column, most: int = 384) -> Column:
    """Share of the pixels of ``inner`` that lie in ``outer``, on a grid of ``most`` places a side at most."""
    lo = lambda c: F.floor(inner[c] - inner["reach"]).cast("long")
    hi = lambda c: F.ceil(inner[c] + inner["reach"]).cast("long")
    x0, x1, y0, y1 = lo("x"), hi("x"), lo("y"), hi("y")
    c = _counts(inner, outer, [x0, x1, y0, y1, _step(x0, x1, y0, y1, most)])
    share = F.when(c["s"] > 0, c["both"] / c["s"]).otherwise(0.0)
    return F.when(_near(outer, inner), share).otherwise(0.0)


#: Places on the rim, and what their squared distance may exceed 1 by.
RIM_PLACES, RIM_SLACK = 72, 1e-3


def rim_share(outer: Column, inner: Column) -> Column:
    """Share of places on the rim of ``inner``, and of its centre, that lie in ``outer``."""
    places = [(math.cos(2 * math.pi * i / RIM_PLACES), math.sin(2 * math.pi * i / RIM_PLACES)) for i in range(RIM_PLACES)] + [(0.0, 0.0)]
    return coverage(places, inner, outer, RIM_SLACK)


def unit_grid(n: int = 9) -> list[tuple[float, float]]:
    """Points of an n by n grid that lie in the unit disk."""
    values = [-1.0 + 2.0 * i / (n - 1) for i in range(n)]
    return [(u, v) for u in values for v in values if u * u + v * v <= 1.0]


def coverage(points: list[tuple[float, float]], s: Column, d: Column, slack: float = 0.0) -> Column:
    """Share of the ellipse ``s``, sampled at unit points, that lies inside ``d``."""
    thin = THIN

    @F.arrow_udf("double")
    def share(one: pa.Array, two: pa.Array) -> pa.Array:
        sx, sy, sa, sb, sc, ss = (one.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "a", "b", "cos", "sin"))
        dx, dy, da, db, dc, ds = (two.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "a", "b", "cos", "sin"))
        da, db, n = np.fmax(da, thin), np.fmax(db, thin), np.zeros(len(one), np.int64)
        for u, v in points:
            px = sx + sc * (sa * u) - ss * (sb * v) - dx
            py = sy + ss * (sa * u) + sc * (sb * v) - dy
            p, q = (dc * px + ds * py) / da, (-ds * px + dc * py) / db
            n += p * p + q * q <= 1.0 + slack
        return pa.array(n / float(len(points)))

    return share(s, d)
