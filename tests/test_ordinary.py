"""Labels of ordinary sources against row-by-row versions; pair measures against counted pixels; quantiles of groups of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ellipses as EL
from lumenfold.operators import jobs
from lumenfold.operators import joins as J
from lumenfold.operators import ordinary as O  # noqa: N812
from lumenfold.operators import pixels as P
from lumenfold.operators import selection as S
from lumenfold.operators.ordinary import A2744Policy, CosmosPolicy

RANK = {"clean": 3, "weak": 2, "strict": 1, "ignore": 0}
FIELDS = "source_id long, g string, x double, y double, a double, b double, theta double, area double, mag double, snr double, warn int, star_mask boolean, model_mag double, fill double, diff double, f_edge boolean, f_bad boolean, center_ok boolean"


def catalog(seed, n, size):
    """Crowded ellipses of whole and of odd sizes, equal magnitudes and areas, and a few unusable rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.choice([1.5, 2.5, 3.0, 4.0, 6.0, 11.0]), rnd.choice([1.5, 2.0, 2.5, 3.0, 5.0])
        x, y = rnd.uniform(0, size), rnd.uniform(0, size)
        if rows and rnd.random() < 0.45:  # near another
            q = rnd.choice([r for r in rows if known(r[2]) and known(r[3])])
            x, y = q[2] + rnd.uniform(-2, 2), q[3] + rnd.uniform(-2, 2)
            if rnd.random() < 0.3 and q[4]:
                a, b = q[4], q[5]
        row = [i, "g", round(x, 2), round(y, 2), a, b, rnd.choice([0.0, 0.4, 1.2, 2.5]), float(round(math.pi * a * b)), float(rnd.randrange(20, 27)), rnd.choice([3.0, 5.0, 6.0, 7.0, 8.0, 30.0, 30.0, 30.0]), rnd.choice([0, 0, 0, 1, 2, 3, 5, 16]), rnd.random() < 0.05, float(rnd.randrange(20, 27)), rnd.random(), rnd.uniform(-1.2, 1.2), rnd.random() < 0.05, False, rnd.random() > 0.03]
        row[12] = row[8] + rnd.choice([0.0, 0.5, 1.0, 2.5])
        if rnd.random() < 0.02:
            row[rnd.choice([2, 4, 5, 8, 9])] = rnd.choice([float("nan"), None])
        rows.append(tuple(row))
    return rows


def names():
    return [f.split()[0] for f in FIELDS.split(", ")]


def records(rows):
    return [dict(zip(names(), r, strict=True)) for r in rows]


def known(v):
    return v is not None and math.isfinite(v)


def usable(r):
    return all(known(r[c]) for c in ("x", "y", "a", "b", "theta", "area")) and r["a"] > 0 and r["b"] > 0 and r["area"] > 0


def inside(r, x, y, slack=EL.RIM):
    c, s = math.cos(r["theta"]), math.sin(r["theta"])
    dx, dy = x - r["x"], y - r["y"]
    return ((c * dx + s * dy) / r["a"]) ** 2 + ((c * dy - s * dx) / r["b"]) ** 2 <= 1 + slack


def reach(r):
    return max(r["a"], r["b"])


def touch(p, q):
    return math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= reach(p) + reach(q)


def share_of(outer, inner, most=384):
    if not touch(outer, inner):
        return 0.0
    x0, x1, y0, y1 = math.floor(inner["x"] - reach(inner)), math.ceil(inner["x"] + reach(inner)), math.floor(inner["y"] - reach(inner)), math.ceil(inner["y"] + reach(inner))
    step = max(1, math.ceil(max(x1 - x0 + 1, y1 - y0 + 1) / most))
    y, x = np.mgrid[y0 : y1 + 1 : step, x0 : x1 + 1 : step]
    own = inside(inner, x, y)
    return float((own & inside(outer, x, y)).sum() / own.sum()) if own.any() else 0.0


def iou_of(p, q):
    y, x = np.mgrid[math.floor(min(p["y"] - reach(p), q["y"] - reach(q))) : math.ceil(max(p["y"] + reach(p), q["y"] + reach(q))) + 1, math.floor(min(p["x"] - reach(p), q["x"] - reach(q))) : math.ceil(max(p["x"] + reach(p), q["x"] + reach(q))) + 1]
    one, two = inside(p, x, y), inside(q, x, y)
    return float((one & two).sum() / (one | two).sum()) if (one | two).any() else 0.0


def rim_of(outer, inner):
    places = [(math.cos(2 * math.pi * i / 72), math.sin(2 * math.pi * i / 72)) for i in range(72)] + [(0, 0)]
    c, s = math.cos(inner["theta"]), math.sin(inner["theta"])
    at = [(inner["x"] + c * inner["a"] * u - s * inner["b"] * v, inner["y"] + s * inner["a"] * u + c * inner["b"] * v) for u, v in places]
    return sum(bool(inside(outer, *p, 1e-3)) for p in at) / len(at)


class Labels:
    def __init__(self, rows):
        self.rows = rows
        self.label = {r["source_id"]: ["clean", ""] for r in rows}
        self.seen = {r["source_id"] for r in rows if r["center_ok"]}
        for r in rows:
            if r["source_id"] not in self.seen:
                self.label[r["source_id"]] = ["ignore", "center_no_data"]

    def cls(self, r):
        return self.label[r["source_id"]][0]

    def lower(self, r, cls, why):
        if RANK[cls] < RANK[self.cls(r)]:
            self.label[r["source_id"]] = [cls, why]
            return True
        return False

    def lower_all(self, rule, cls, why):
        for r in [r for r in self.rows if self.cls(r) != "ignore" and rule(r)]:
            self.lower(r, cls, why)


def plain_sweep(rows, share):
    """In order of x: each source there at its turn meets later ones, until one is too far off by x alone."""
    order = sorted((r for r in rows if usable(r)), key=lambda r: (r["x"], r["source_id"]))
    gone = set()
    for k, p in enumerate(order):
        if p["source_id"] in gone:
            continue
        for q in order[k + 1 :]:
            if q["x"] - p["x"] > reach(p) + reach(q):
                break
            if q["source_id"] in gone or not touch(p, q):
                continue
            small, large = (p, q) if p["area"] <= q["area"] else (q, p)
            if share_of(large, small) >= share:
                gone.add(large["source_id"])
    return gone


@pytest.mark.parametrize("most", [0, 10**6])
def test_sweep_by_x_with_its_early_end(spark, most):
    rows = catalog(3, 220, 40.0)
    got = {r.id for r in O.swept_containment(spark.createDataFrame(rows, FIELDS), ["g"], 0.6, most).collect()}
    want = plain_sweep(records(rows), 0.6)
    assert got == want and len(want) > 20


def plain_hsc(rows):
    s = Labels(rows)
    s.lower_all(lambda r: not (known(r["diff"]) and abs(r["diff"]) <= 1.0), "ignore", "ap2_kron")
    s.lower_all(lambda r: known(r["area"]) and r["area"] > 500 and r["fill"] < 0.3, "strict", "fill_ratio")
    for r in rows:
        if s.cls(r) == "clean" and (r["f_edge"] or r["f_bad"]):
            s.lower(r, "ignore", "flag")
    gone = plain_sweep([r for r in rows if s.cls(r) == "clean"], 0.8)
    for r in rows:
        if r["source_id"] in gone:
            s.lower(r, "ignore", "containment")
        elif s.cls(r) == "clean":
            v = r["snr"] if known(r["snr"]) else 0.0
            if v <= 5:
                s.lower(r, "ignore", "snr_ignore")
            elif v <= 7 or (v <= 10 and known(r["area"]) and r["area"] > 500):
                s.lower(r, "weak", "snr_weak")
    return s.label


def test_hsc_row_by_row(spark):
    rows = catalog(5, 300, 60.0)
    got = {r.source_id: [r["class"], r.reason] for r in O.label_ordinary_hsc(spark.createDataFrame(rows, FIELDS), ["g"], F.lit(False)).collect()}
    assert got == plain_hsc(records(rows))
    assert {"containment", "ap2_kron", "flag", "center_no_data"} <= {w for _, w in got.values()}


def plain_cosmos(rows, p):
    s = Labels(rows)
    s.lower_all(lambda r: not usable(r), "ignore", "invalid_geometry")
    s.lower_all(lambda r: r["warn"] in p.warn_ignore, "ignore", "warn")
    s.lower_all(lambda r: r["star_mask"], "strict", "star_mask")
    good = lambda r: known(r["mag"]) and r["mag"] < 90 and known(r["model_mag"]) and r["model_mag"] < 90
    diff = lambda r: abs(r["mag"] - r["model_mag"])
    s.lower_all(lambda r: not good(r) or diff(r) > 2, "ignore", "photometry")
    s.lower_all(lambda r: diff(r) >= 1, "strict", "photometry")
    able = [r for r in rows if s.cls(r) != "ignore" and known(r["snr"]) and r["snr"] > 5 and usable(r)]
    gone = set()
    for i, q in enumerate(able):
        for r in able[i + 1 :]:
            if q["source_id"] in gone or r["source_id"] in gone or not touch(q, r):
                continue
            small, large = (q, r) if q["area"] <= r["area"] else (r, q)
            if rim_of(large, small) >= p.containment:
                gone.add(large["source_id"])
    for r in rows:
        if r["source_id"] in gone:
            s.lower(r, "strict", "containment")
    s.lower_all(lambda r: r["mag"] < p.fill_mag and 0 <= r["fill"] < p.fill_least, "strict", "low_fill")
    s.lower_all(lambda r: not (known(r["snr"]) and r["snr"] > 5), "ignore", "snr_ignore")
    s.lower_all(lambda r: r["snr"] < 7, "strict", "snr_strict")
    return s.label


def test_cosmos_row_by_row(spark):
    rows, p = catalog(7, 300, 60.0), CosmosPolicy(containment=0.9)
    got = {r.source_id: [r["class"], r.reason] for r in O.label_ordinary_cosmos(spark.createDataFrame(rows, FIELDS), ["g"], p).collect()}
    assert got == plain_cosmos(records(rows), p)
    assert {"containment", "photometry", "low_fill", "snr_strict"} <= {w for _, w in got.values()}


def plain_a2744(rows, p, star_pixels, frame, measured):
    """Pass after pass over all pairs until no label changes; then protection and apertures in turn."""
    s = Labels(rows)
    usable_rows = [r for r in rows if usable(r) and r["source_id"] in s.seen]
    s.lower_all(lambda r: not usable(r), "ignore", "invalid_geometry")
    flagged = {r["source_id"] for r in usable_rows if r["warn"] in p.flag_ignore}
    s.lower_all(lambda r: r["source_id"] in flagged, "ignore", "flag")
    s.lower_all(lambda r: r["a"] < p.fwhm or r["b"] < p.fwhm, "ignore", "psf_size")
    close, left = set(), [r for r in rows if s.cls(r) != "ignore"]
    for i, q in enumerate(left):
        for r in left[i + 1 :]:
            if math.hypot(q["x"] - r["x"], q["y"] - r["y"]) <= p.fwhm and not {q["source_id"], r["source_id"]} & close:
                first = known(q["mag"]) and known(r["mag"]) and q["mag"] < r["mag"]
                close.add((q if first else r)["source_id"])
    s.lower_all(lambda r: r["source_id"] in close, "ignore", "close_brighter")
    pairs = [(q, r, iou_of(q, r), share_of(q, r), share_of(r, q)) for i, q in enumerate(usable_rows) for r in usable_rows[i + 1 :] if touch(q, r)]

    def protect():
        before = dict((r["source_id"], s.cls(r)) for r in rows)
        hit = []
        for q, r, _, in_q, in_r in pairs:
            for outer, inner, held in ((q, r, in_q), (r, q, in_r)):
                if before[outer["source_id"]] in ("clean", "weak") and before[inner["source_id"]] == "ignore" and outer["area"] >= inner["area"] and held >= p.containment:
                    hit.append(outer)
        return any([s.lower(r, "strict", "contains_ignore") for r in hit])

    protect()
    rank = dict(p.ranks)

    def change(r, cls, why):
        if cls != "ignore" and r["source_id"] in flagged:
            cls = "ignore"
        elif cls != "ignore" and r["warn"] not in rank:
            cls = "weak"
        return s.lower(r, cls, why)

    while True:
        changed = False
        for q, r, iou, in_q, in_r in pairs:
            fq, fr = q["source_id"] in flagged, r["source_id"] in flagged
            if (s.cls(q) == "ignore" and not fq) or (s.cls(r) == "ignore" and not fr) or (fq and fr):
                continue
            if iou >= p.iou:
                loser = q if fq else r if fr else q if known(q["mag"]) and known(r["mag"]) and q["mag"] >= r["mag"] else r
                changed |= change(loser, "ignore", "high_iou")
                continue
            if in_q >= p.containment and (q["area"] >= r["area"] or in_r < p.containment):
                large, small = q, r
            elif in_r >= p.containment:
                large, small = r, q
            else:
                continue
            lp, sp = (-1 if e["source_id"] in flagged else rank.get(e["warn"], 0) for e in (large, small))
            if lp < sp:
                changed |= change(large, "ignore", "low_priority_parent")
            elif small["source_id"] in flagged:
                changed |= s.lower(large, "strict", "contains_ignore")
            else:
                changed |= change(large, "weak" if lp > sp else "strict", "containment_candidate")
                changed |= change(small, "weak", "containment_candidate")
        if not changed:
            break
    s.lower_all(lambda r: not known(r["snr"]) or r["snr"] < 5, "ignore", "snr_ignore")
    s.lower_all(lambda r: r["snr"] < 7, "weak", "snr_weak")

    def starred(r):
        if not usable(r):
            return False
        on = n = 0
        for k in (0.0, 0.5, 1.0):
            for i in range(48):
                t = 2 * math.pi * i / 48
                u, v = r["a"] * k * math.cos(t), r["b"] * k * math.sin(t)
                c, w = math.cos(r["theta"]), math.sin(r["theta"])
                px, py = round(r["x"] + c * u - w * v), round(r["y"] + w * u + c * v)
                if 0 <= px < frame[0] and 0 <= py < frame[1]:
                    n += 1
                    on += (px, py) in star_pixels
        return (round(r["x"]), round(r["y"])) in star_pixels or (n and on / n >= p.star_overlap)

    s.lower_all(lambda r: known(r["mag"]) and r["mag"] >= p.star_mag and starred(r), "ignore", "star_mask")
    protect()

    def apertures():
        for r in [r for r in rows if s.cls(r) != "ignore" and (p.aperture_mag is None or (known(r["mag"]) and r["mag"] > p.aperture_mag))]:
            snr, trusted = measured.get(r["source_id"], (None, False))
            if trusted or s.cls(r) == "strict":
                if not known(snr) or snr < 5:
                    s.lower(r, "ignore", "aperture_snr_ignore")
                elif snr < 7:
                    s.lower(r, "strict", "aperture_snr_center")

    apertures()
    while protect():
        apertures()
    return s.label


@pytest.mark.parametrize("seed, p, most", [(11, A2744Policy(containment=0.7, iou=0.6), 10**6), (12, A2744Policy(fwhm=0.6, containment=0.5, iou=0.5, aperture_mag=22.0, star_mag=22.0), 0)])
def test_a2744_row_by_row(spark, seed, p, most):
    rows, frame = catalog(seed, 260, 50.0), (48, 52)
    rnd = random.Random(seed)
    stars = {(x, y) for cx, cy in [(10, 10), (30, 41), (45, 5)] for x in range(cx - 4, cx + 5) for y in range(cy - 4, cy + 5) if 0 <= x < frame[0] and 0 <= y < frame[1]}
    measured = {r[0]: (rnd.choice([2.0, 5.0, 6.0, 9.0, 20.0, 20.0, None]), rnd.random() < 0.6) for r in rows if rnd.random() < 0.9}
    mask = spark.createDataFrame([("g", x, y) for x, y in stars], "g string, x int, y int")
    table = spark.createDataFrame([(i, *v) for i, v in measured.items()], "source_id long, snr double, trusted boolean")
    found = O.label_ordinary_a2744(spark.createDataFrame(rows, FIELDS).drop("star_mask"), ["g"], p, mask, frame, table, most)
    got = {r.source_id: [r["class"], r.reason] for r in found.collect()}
    assert got == plain_a2744(records(rows), p, stars, frame, measured)
    wanted = {"low_priority_parent", "contains_ignore", "containment_candidate", "star_mask", "aperture_snr_ignore", "aperture_snr_center"}
    assert wanted | ({"high_iou"} if seed == 12 else set()) <= {w for _, w in got.values()}


def test_labels_of_no_sources(spark):
    none = spark.createDataFrame([], FIELDS)
    for found in (O.label_ordinary_hsc(none, ["g"], F.lit(False)), O.label_ordinary_cosmos(none, ["g"]), O.label_ordinary_a2744(none, ["g"])):
        assert found.count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_close_pairs_whose_losers_still_act(spark, most):
    rnd = random.Random(2)
    rows = [(i, "g", round(rnd.uniform(0, 14), 2), round(rnd.uniform(0, 14), 2), rnd.choice([20.0, 21.0, 22.0, 23.0, float("nan"), None])) for i in range(120)]
    gone, able = set(), [r for r in rows if known(r[4])]
    for i, p in enumerate(able):
        if p[0] in gone:
            continue
        for q in able[i + 1 :]:
            if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 < 2.25:
                gone.add(p[0] if p[4] >= q[4] else q[0])
    got = {r.id for r in O.fainter_of_close(spark.createDataFrame(rows, "source_id long, g string, x double, y double, mag double"), 1.5, ["g"], most).collect()}
    assert got == gone and len(gone) > 20


def test_basics_row_by_row(spark):
    rows = records(catalog(21, 250, 70.0))
    for r in rows:
        r |= {"in_base": r["source_id"] % 6 > 0, "valid_kron": r["source_id"] % 31 > 0, "area": 1500.0 if r["source_id"] % 5 == 0 else r["area"], "mag": 28.5 if r["source_id"] % 4 == 0 else r["mag"]}
    table = spark.createDataFrame([tuple(r[c] for c in [*names(), "in_base", "valid_kron"]) for r in rows], FIELDS + ", in_base boolean, valid_kron boolean")
    got = {r.source_id: (r["class"], r.reason) for r in jobs.classify_basics(table, ["g"]).collect()}
    want, left = {}, []
    for r in rows:
        ok = usable(r) and known(r["mag"]) and r["valid_kron"]
        same = r["area"] * (0.168 / 0.168) ** 2 if known(r["area"]) else None
        state = ("ignore", "center_no_data") if not r["center_ok"] else ("dropped", "source_filter") if not r["in_base"] else ("ignore", "invalid") if not ok else ("dropped", "A_area_gt_max") if same > 10000 else ("dropped", "A_faint_large") if same > 900 and r["mag"] > 28 else ("ignore", "B_mag_gt_max") if r["mag"] > 30 else ("ignore", "B_axis_ratio") if reach(r) / min(r["a"], r["b"]) > 6 else None
        if state is None:
            left.append(r)
            state = ("bright" if r["mag"] < 22 else "ordinary", "")
        want[r["source_id"]] = state
    gone = set()
    for i, p in enumerate(left):
        if p["source_id"] not in gone:
            for q in left[i + 1 :]:
                if math.hypot(p["x"] - q["x"], p["y"] - q["y"]) < 3.0:
                    gone.add((p if p["mag"] >= q["mag"] else q)["source_id"])
    want |= {i: ("ignore", "B_close_pair_dimmer") for i in gone}
    assert got == want and {"center_no_data", "B_close_pair_dimmer", "A_faint_large"} <= {w for _, w in got.values()}


def test_measures_of_pairs_count_pixels(spark):
    """Whole and broken places and axes, rims on pixels, flat ellipses, and boxes wider than the grid."""
    rnd = random.Random(8)
    one = lambda: (float(rnd.randrange(0, 9)), float(rnd.randrange(0, 9)), rnd.choice([0.3, 1.0, 2.5, 5.0, 5.0, 7.25]), rnd.choice([0.2, 1.0, 5.0, 3.0]), rnd.choice([0.0, 0.7, 2.5]))
    pairs = [(i, *one(), *one()) for i in range(120)] + [(500, 0.0, 0.0, 700.0, 300.0, 0.3, 100.0, 5.0, 650.0, 200.0, 1.0)]
    table = spark.createDataFrame(pairs, "i int, x double, y double, a double, b double, t double, x2 double, y2 double, a2 double, b2 double, t2 double")
    s, t = EL.shape(*map(F.col, ("x", "y", "a", "b", "t"))), EL.shape(*map(F.col, ("x2", "y2", "a2", "b2", "t2")))
    got = table.select("i", EL.pixel_iou(s, t, None).alias("iou"), EL.area_share(s, t).alias("share"), EL.rim_share(s, t).alias("rim")).collect()
    keys = ("x", "y", "a", "b", "theta")
    for r, p in zip(sorted(got), pairs, strict=True):
        q, u = dict(zip(keys, p[1:6], strict=True)), dict(zip(keys, p[6:], strict=True))
        assert (r.iou, r.share, r.rim) == pytest.approx((iou_of(q, u) if touch(q, u) else 0.0, share_of(q, u), rim_of(q, u)), abs=1e-12)


def test_pixels_of_ellipses(spark):
    rows = [(0, 3.0, 4.0, 5.0, 5.0, 2.5), (1, -2.0, 1.5, 6.0, 1.0, 0.5), (2, 19.0, 19.0, 3.0, 0.4, 1.0), (3, 50.0, 3.0, 2.0, 2.0, 0.0), (4, 5.0, 5.0, float("nan"), 1.0, 0.0), (5, 5.0, 5.0, 0.0, 1.0, 0.0), (6, 7.5, 7.5, 0.3, 0.3, 0.0)]
    got = {(r.id, r.x, r.y) for r in P.rasterize_ellipse(spark.createDataFrame(rows, "id int, cx double, cy double, a double, b double, theta double"), 20, 20).collect()}
    want = {(i, x, y) for i, cx, cy, a, b, t in rows if a > 0 and b > 0 for x in range(20) for y in range(20) if inside({"x": cx, "y": cy, "a": a, "b": b, "theta": t}, x, y)}
    assert got == want and (0, 6, 8) in got


@pytest.mark.parametrize("most", [40, 10**6])
def test_quantiles_of_groups_of_any_size(spark, most):
    rnd = np.random.default_rng(4)
    groups = {"spread": rnd.normal(size=700), "ties": rnd.integers(0, 3, 500).astype(float), "equal": np.full(300, 2.5), "far": np.concatenate([rnd.normal(size=300) * 1e-12, [1e300, -1e300]]), "small": rnd.normal(size=31), "two": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", float("nan")), ("none", None), ("spread", float("inf"))]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.a, r.b, r.c) for r in S.exact_quantiles(table, "v", ["g"], {"a": 0.01, "b": 0.5, "c": 0.99}, most).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.01, 0.5, 0.99])), rel=1e-12, abs=1e-24)
    whole = S.exact_quantiles(table.filter("g <> 'far'"), "v", [], {"m": 0.5}, most).first().m
    assert whole == pytest.approx(np.median(np.concatenate([v for g, v in groups.items() if g != "far"])), rel=1e-12)


@pytest.mark.parametrize("fresh", [False, True])
@pytest.mark.parametrize("fall_back", [False, True])
def test_clipping_in_place_and_by_rounds(spark, fresh, fall_back):
    rnd = np.random.default_rng(6)
    rows = [("a", float(v)) for v in np.concatenate([rnd.normal(size=400), rnd.normal(size=20) * 30])] + [("b", float(v)) for v in [1.0] * 60 + [2.0, 50.0, 3.0]] + [("c", float(v)) for v in rnd.integers(0, 9, 25)]
    table = spark.createDataFrame(rows, "g string, v double")
    found = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in S.clipped(table, "v", ["g"], 2.0, 3, fresh, fall_back, most).collect()) for most in (10**6, 30)]
    assert found[0] == found[1] and len(found[0]) == 3


def test_clipping_reads_its_values_once(spark):
    """Rounds are windows over one shuffle: the plan grows with the rounds, its scans do not."""
    table = spark.range(2000).selectExpr("id % 7 AS g", "CAST(id * 37 % 101 AS DOUBLE) AS v")
    for rounds in (1, 4):
        plan = S.clipped(table, "v", ["g"], 3.0, rounds)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Join") == 0


def test_one_wide_tile_among_small_ones(spark):
    tiles = spark.createDataFrame([("wide", 0.0, 0.0, 5000), *[(f"t{i}", i * 40.0, 10.0, 30) for i in range(20)]], "name string, x0 double, y0 double, size int")
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-10, 900), rnd.uniform(-10, 60)) for i in range(300)]
    got = {(r.id, r.name) for r in J.source_in_tile(spark.createDataFrame(points, "id int, x double, y double"), tiles, 2.0).collect()}
    assert got == {(i, n) for i, x, y in points for n, x0, y0, s in [tuple(t) for t in tiles.collect()] if x0 - 2 <= x < x0 + s + 2 and y0 - 2 <= y < y0 + s + 2}


def test_footprints_meet_a_mask_in_tiles(spark):
    """Ellipses on the edges of tiles and of the frame, far off, and larger than many tiles; a mask with repeats and pixels off the frame."""
    rnd, frame = random.Random(9), (200, 150)
    shapes = [(rnd.uniform(-5, 205), rnd.uniform(-5, 155), rnd.choice([0.4, 3.0, 9.0, 30.0, 70.0, 300.0]), rnd.choice([0.4, 2.0, 8.0, 90.0]), rnd.choice([0.0, 0.7, 2.0])) for _ in range(150)]
    shapes += [(64.0, 64.0, 1.0, 1.0, 0.0), (63.5, 127.5, 2.0, 1.0, 0.3), (0.0, 0.0, 5.0, 5.0, 0.0), (199.0, 149.0, 5.0, 5.0, 0.0), (1e200, 5.0, 3.0, 3.0, 0.0), (100.0, 70.0, 1e200, 1e200, 0.5), (100.0, -400.0, 3.0, 2.0, 0.0), (5.0, 5.0, 0.0, 2.0, 0.0)]
    rows = [(i, rnd.choice("gh"), x, y, a, b, t, 10.0) for i, (x, y, a, b, t) in enumerate(shapes)]
    lit = [(rnd.choice("gh"), rnd.randrange(-9, 209), rnd.randrange(-9, 159)) for _ in range(9000)]
    sources = spark.createDataFrame(rows, "source_id long, g string, x double, y double, a double, b double, theta double, area double")
    made = O.footprint_share(sources, spark.createDataFrame(lit + lit[:500], "g string, x int, y int"), ["g"], frame)
    want, set_of = {}, set(lit)
    for i, g, x, y, a, b, t, _ in rows:
        c, s = math.cos(t), math.sin(t)
        angles = [2 * math.pi * k / O.FOOTPRINT_ANGLES for k in range(O.FOOTPRINT_ANGLES)]
        places = [(0.0, 0.0)] * O.FOOTPRINT_ANGLES + [(r * math.cos(q), r * math.sin(q)) for r in O.FOOTPRINT_RADII for q in angles]
        at = [(round(x + c * a * u - s * b * v), round(y + s * a * u + c * b * v)) for u, v in places] if a > 0 else []
        at = [q for q in at if 0 <= q[0] < frame[0] and 0 <= q[1] < frame[1]]
        on = sum((g, *q) in set_of for q in at)
        if on:
            want[i] = (on / len(at), (g, round(x), round(y)) in set_of and 0 <= round(x) < frame[0] and 0 <= round(y) < frame[1])
    assert {r.source_id: (r.share, r.center) for r in made.collect()} == want
    assert len(want) > 100 and any(c for _, c in want.values()) and 155 in want
    # Not a row for each place of each ellipse.
    assert "explode(at#" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_tables_between_rules_hold_no_column_that_no_rule_looks_at(spark):
    wide = spark.createDataFrame(catalog(13, 40, 30.0), FIELDS).withColumn("wide", F.raise_error(F.lit("looked at")).cast("string"))
    table = spark.createDataFrame([(i, 6.0, True, 1.0) for i in range(40)], "source_id long, snr double, trusted boolean, area double")
    assert O.label_ordinary_a2744(wide, ["g"], measured=table).count() == 40
