"""Classes, matchings, moments and labels against plain versions, row by row; flat and missing ellipses."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import jobs
from lumenfold.operators import ellipses as EL
from lumenfold.operators import joins as J
from lumenfold.operators import objects as O  # noqa: N812
from lumenfold.operators import pixels as P
from lumenfold.operators import rules as R
from lumenfold.operators import windows as W
from lumenfold.operators.graph import connected_components

NAN = float("nan")


def points(seed, n, size=12.0, start=0):
    rnd = random.Random(seed)
    return [(start + i, round(rnd.uniform(0, size), 3), round(rnd.uniform(0, size), 3), round(rnd.uniform(18, 28), 2), round(rnd.uniform(1, 30), 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, source_id long, x double, y double, mag double, area double")


def dist(p, q):
    return math.hypot(p[1] - q[1], p[2] - q[2])


@pytest.mark.parametrize("most", [1, 100_000])
def test_matching_in_tasks_and_in_rounds(spark, most):
    a, b = points(11, 70), points(61, 60)  # both sides use the same ids
    edges = sorted((dist(p, q), p[0], q[0]) for p in a for q in b if dist(p, q) <= 2.0)
    used_a, used_b, want = set(), set(), set()
    for _, i, j in edges:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.add((i, j))
    pairs = J.pairs_within(frame(spark, a), frame(spark, b), 2.0, ["g"], "source_id", "source_id")
    got = [(r.a, r.b) for r in J.greedy_match(pairs, ["g"], most).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("most", [1, 100_000])
def test_removals_in_tasks_and_in_rounds(spark, most):
    rnd = random.Random(5)
    edges = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)})
    rows = [(a, b, rnd.choice((a, b))) for a, b in edges]
    gone = set()
    for a, b, loser in rows:
        if a not in gone and b not in gone:
            gone.add(loser)
    got = {r.id for r in J.ordered_removal(spark.createDataFrame(rows, "a long, b long, loser long"), ["a", "b"], most).collect()}
    assert got == gone


@pytest.mark.parametrize("most", [1, 100_000])
def test_priorities_in_tasks_and_in_rounds(spark, most):
    rows = points(14, 90)
    kept, want = [], {}
    for p in sorted(rows, key=lambda p: (p[3], p[0])):
        near = [(q[3], q[0]) for q in kept if dist(p, q) <= 1.5]
        if near:
            want[p[0]] = min(near)[1]
        else:
            kept.append(p)
    assert {r.a: r.keep for r in J.priority_dedup(frame(spark, rows), 1.5, ["g"], [F.col("mag")], most).collect()} == want


def test_two_stages_take_clean_targets_first(spark):
    a, b = points(21, 50), points(71, 60, start=1000)
    clean, rest = b[:30], b[30:]
    used, want = set(), set()
    for stage, targets in ((1, clean), (2, rest)):
        for _, i, j in sorted((dist(p, q), p[0], q[0]) for p in a for q in targets if dist(p, q) <= 2.0):
            if i not in used and j not in used:
                used |= {i, j}
                want.add((i, j, stage))
    got = J.two_stage_match(frame(spark, a), frame(spark, clean), frame(spark, rest), 2.0, ["g"], "source_id", "source_id").collect()
    assert {(r.a, r.b, r.stage) for r in got} == want and len(got) == len(want)


def test_components_by_contraction_alone(spark):
    """No edge is left to one task: paths in order and out of order, stars, and two components of random edges."""
    rnd = random.Random(9)
    path = list(range(5000, 5060))
    rnd.shuffle(path)
    edges = [(i, i + 1) for i in range(80)] + list(zip(path, path[1:], strict=False)) + [(900, 1000 + i) for i in range(40)]
    edges += [tuple(rnd.sample(range(2000, 2040), 2)) for _ in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), finish=0).collect()}
    assert got == {x: find(x) for x in up}


def shapes(seed, n, size=60.0):
    """Random ellipses, a few of them flat, negative or not measured."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = round(rnd.uniform(0.5, 6), 2), round(rnd.uniform(0.5, 6), 2)
        if i % 23 == 0:
            a = (0.0, -1.0, NAN)[i // 23 % 3]
        rows.append(dict(source_id=i, g="g", x=round(rnd.uniform(0, size), 2), y=round(rnd.uniform(0, size), 2), a=a, b=b, theta=round(rnd.uniform(0, 3), 2), area=round(abs(a * b) * 3, 2) if a == a else 5.0, mag=round(rnd.uniform(20, 29), 2), diff=round(rnd.uniform(-1.3, 1.3), 2), fill=round(rnd.uniform(0, 1), 2), component=0.0, valid_kron=i % 17 > 0, in_base=i % 13 > 0, f_edge=i % 19 == 0, f_bad=False))
    return rows


GRID = EL.unit_grid()


def covered(s, d):
    inside = 0
    for u, v in GRID:
        px = s["x"] + math.cos(s["theta"]) * (s["a"] * u) - math.sin(s["theta"]) * (s["b"] * v) - d["x"]
        py = s["y"] + math.sin(s["theta"]) * (s["a"] * u) + math.cos(s["theta"]) * (s["b"] * v) - d["y"]
        p, q = (math.cos(d["theta"]) * px + math.sin(d["theta"]) * py) / max(d["a"], 1e-6), (-math.sin(d["theta"]) * px + math.cos(d["theta"]) * py) / max(d["b"], 1e-6)
        inside += p * p + q * q <= 1
    return inside / len(GRID)


def test_overlaps_of_all_sizes(spark):
    """Pairs found by size classes are those of all pairs whose circles touch; flat ellipses hold next to nothing."""
    rows = shapes(2, 120) + [dict(shapes(2, 1)[0], source_id=900, x=30.0, y=30.0, a=40.0, b=35.0, area=4000.0)]
    got = {(r.a, r.b): r for r in J.ellipse_overlap_join(spark.createDataFrame(rows), None, ["g"]).collect()}
    real = [r for r in rows if r["a"] == r["a"]]
    want = {(s["source_id"], t["source_id"]): (s, t) for s in real for t in real if s["source_id"] < t["source_id"] and math.hypot(s["x"] - t["x"], s["y"] - t["y"]) <= max(s["a"], s["b"]) + max(t["a"], t["b"])}
    assert set(got) == set(want)
    for k, (s, t) in want.items():
        assert got[k].in_b == pytest.approx(covered(s, t)) and got[k].in_a == pytest.approx(covered(t, s))
    held = J.containment_losers(J.ellipse_overlap_join(spark.createDataFrame(rows), None, ["g"]), 0.8).collect()
    gone = set()
    for k in sorted(want):
        s, t = want[k]
        if k[0] in gone or k[1] in gone or s["area"] <= 0 or t["area"] <= 0:
            continue
        small, large = (s, t) if s["area"] <= t["area"] else (t, s)
        if covered(small, large) >= 0.8:
            gone.add(large["source_id"])
    assert {r.id for r in held} == gone and gone


@pytest.mark.parametrize("marks", [None, "both", "smaller"])
def test_classes_row_by_row(spark, marks):
    """The classifier against its rules written out, in the order in which later classes win."""
    p = R.ClassPolicy(area_max=80.0, faint_area_max=40.0, faint_mag_min=27.0, fill_area_min=20.0, bright_mag=21.0, mag_range=(21.0, 28.5), close_radius=1.5, overlap_iou=0.1 if marks else None, overlap_marks=marks or "both", neighbor_radius=8.0)
    rows = shapes(7, 160)
    ok = lambda v: v == v
    cls, b_candidate, removed = {}, set(), set()
    for r in rows:
        i = r["source_id"]
        good = r["in_base"] and r["valid_kron"] and ok(r["a"]) and r["a"] > 0 and r["b"] > 0
        dropped = good and r["area"] > 80
        failed = good and (dropped or (r["area"] > 40 and r["mag"] > 27))
        hard = abs(r["diff"]) >= 1 and r["mag"] < 21
        hollow = good and not failed and r["area"] > 20 and r["fill"] < 0.3 and not hard
        cls[i] = "outside_base" if not r["in_base"] else "b_ignore" if not good else "dropped_area" if dropped else "a_failed" if failed else "center_only" if hollow else None
        if cls[i] is None:
            b_candidate.add(i)
            ordinary = r["mag"] >= 21
            ratio = max(r["a"], r["b"]) / min(r["a"], r["b"])
            if hard or (ordinary and r["mag"] > 28.5) or ratio > 6 or (ordinary and abs(r["diff"]) >= 1) or (ordinary and r["f_edge"]):
                removed.add(i)
    by = {r["source_id"]: r for r in rows}
    at = lambda i, j: math.hypot(by[i]["x"] - by[j]["x"], by[i]["y"] - by[j]["y"])
    close = set()
    live = sorted(b_candidate - removed)
    for i in live:
        for j in live:
            if i < j and at(i, j) <= 1.5:
                s, t = by[i], by[j]
                close.add(i if s["mag"] > t["mag"] or (s["mag"] == t["mag"] and s["area"] >= t["area"]) else j)
    ordinary = sorted(i for i in live if i not in close and by[i]["mag"] >= 21)
    held = set()
    for i in ordinary:
        for j in ordinary:
            if i < j and i not in held and j not in held:
                small, large = (i, j) if by[i]["area"] <= by[j]["area"] else (j, i)
                if covered(by[small], by[large]) >= 0.8:
                    held.add(large)
    clean = sorted(b_candidate - removed - close - held)
    vague = set()
    for i in clean if marks else ():
        for j in clean:
            if i < j and at(i, j) <= 8.0:
                s, t = by[i], by[j]
                shared = 0.5 * (covered(s, t) * s["area"] + covered(t, s) * t["area"])
                if shared / (s["area"] + t["area"] - shared) >= 0.1:
                    vague |= {i, j} if marks == "both" else {i if s["area"] <= t["area"] else j}
    for i in b_candidate:
        cls[i] = "center_only" if i in vague else "clean" if i in clean else "b_ignore"
    got = {r.source_id: r["class"] for r in jobs.classify_sources(spark.createDataFrame(rows), ["g"], p).collect()}
    assert got == cls and (not marks or vague)


def test_stars_meet_members_before_centroids(spark):
    rnd = random.Random(3)
    members = [("g", c, rnd.uniform(0, 40), rnd.uniform(0, 40)) for c in range(12) for _ in range(3)]
    stars = [("g", s, rnd.uniform(0, 40), rnd.uniform(0, 40)) for s in range(40)]
    want = {}
    for _, s, x, y in stars:
        for c in range(12):
            own = [m for m in members if m[1] == c]
            near = min(math.hypot(m[2] - x, m[3] - y) for m in own)
            far = math.hypot(sum(m[2] for m in own) / 3 - x, sum(m[3] for m in own) / 3 - y)
            if near <= 3:
                want[s, c] = ("source_center", near)
            elif far <= 6:
                want[s, c] = ("cluster_centroid", far)
    found = W.stars_near_clusters(spark.createDataFrame(members, "g string, cluster long, x double, y double"), spark.createDataFrame(stars, "g string, star_id long, x double, y double"), 3.0, 6.0, ["g"])
    got = {(r.star_id, r.cluster): (r.mode, pytest.approx(r.d)) for r in found.collect()}
    assert {k: (m, d) for k, (m, d) in want.items()} == got and {m for m, _ in want.values()} == {"source_center", "cluster_centroid"}
    best = {}
    for (s, c), (m, d) in sorted(want.items(), key=lambda x: (x[1][1], x[0][1])):
        best.setdefault(s, (c, m))
    assert {r.star_id: (r.cluster, r.mode) for r in W.assign_stars(found, ["g"]).collect()} == best


def test_kron_moments_with_missing_and_negative_pixels(spark):
    rnd = random.Random(6)
    values = {(x, y): rnd.choice([NAN, -3.0, rnd.uniform(0, 50)]) if rnd.random() < 0.3 else rnd.uniform(0, 50) for x in range(20) for y in range(20)}
    pixels = spark.createDataFrame([("g", x, y, v) for (x, y), v in values.items() if (x, y) != (9, 9)], "g string, x int, y int, image double")
    values.pop((9, 9))
    sources = [(1, 9.3, 9.1, 2.0, 1.0, 0.4), (2, 0.0, 0.0, 1.5, 1.5, 0.0), (3, 9.0, 9.0, 4.0, 3.0, 1.0)]
    spans = [("g", i, y, int(cx) - 6, int(cx) + 6) for i, cx, cy, *_ in sources for y in range(int(cy) - 5, int(cy) + 6)]
    got = {r.id: r for r in P.kron_moment(spark.createDataFrame(spans, "g string, id long, y int, x0 int, x1 int"), pixels, spark.createDataFrame(sources, "id long, cx double, cy double, a double, b double, theta double"), ["g"], 2.0).collect()}
    for i, cx, cy, a, b, t in sources:
        total = weighted = positive = negative = 0.0
        n = central = 0
        for _, k, y, x0, x1 in spans:
            for x in range(x0, x1 + 1) if k == i else ():
                v = values.get((x, y), NAN)
                v = v if v == v else 0.0
                dx, dy = x - cx, y - cy
                u, w = dx * math.cos(t) + dy * math.sin(t), -dx * math.sin(t) + dy * math.cos(t)
                far, r = math.hypot(dx, dy), math.hypot(u, w * a / b)
                if far < 0.5:
                    central += 1
                    r = math.hypot(r, P.CENTRAL_PIXEL * (1 + far / math.sqrt(2)))
                if (u / (2 * a)) ** 2 + (w / (2 * b)) ** 2 <= 1:
                    n, total, weighted, positive, negative = n + 1, total + v, weighted + r * v, positive + max(v, 0), negative + min(v, 0)
        m = got[i]
        assert (m.n, m.central) == (n, central) and m.total == pytest.approx(total) and m.positive == pytest.approx(positive) and m.negative == pytest.approx(negative)
        candidate = weighted / total * math.sqrt(b / a)
        assert m.candidate == pytest.approx(candidate) and m.radius == pytest.approx(2 * math.sqrt(a * b) if candidate <= math.sqrt(a * b) else candidate)


def test_clipping_narrows_or_looks_at_all_values_anew(spark):
    rnd = random.Random(8)
    groups = {"noise": [rnd.gauss(0, 1) for _ in range(200)] + [rnd.uniform(5, 40) for _ in range(20)], "flat": [1.0] * 30 + [2.0], "one": [3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("noise", NAN)], "g string, v double")
    med = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    sd = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))
    for fresh, fall_back in ((False, False), (True, False), (False, True)):
        got = {r.g: r for r in P.clipped(df, "v", ["g"], fresh=fresh, fall_back=fall_back).collect()}
        for g, vs in groups.items():
            kept = vs
            for _ in range(2):
                robust = 1.4826 * med([abs(x - med(kept)) for x in kept])
                robust = robust if robust > 0 or not fall_back else sd(kept)
                if robust > 0:
                    kept = [x for x in (vs if fresh else kept) if abs(x - med(kept)) <= 3 * robust]
            assert got[g].n == len(kept) and got[g].med == pytest.approx(med(kept)) and got[g].sd == pytest.approx(sd(kept))


def test_rescue_row_by_row(spark):
    rows = [dict(r, n_child=0, old_diff=1.4, new_diff=r["diff"] * 1.3, fill=r["fill"], ignored=r["source_id"] % 4 > 0, clean=r["source_id"] % 4 == 0, skip=r["source_id"] % 29 == 0) for r in shapes(12, 150)]
    p = R.RescuePolicy(area_max=70.0, faint_mag=27.0, faint_area=30.0)
    state = {}
    for r in rows:
        if r["ignored"] and not r["skip"]:
            real = r["a"] == r["a"] and r["a"] > 0
            ratio = max(abs(r["a"]), abs(r["b"])) / min(abs(r["a"]), abs(r["b"])) if real else 0
            new = abs(r["new_diff"])
            bad = not real or (new <= 1.5 and r["fill"] < 0.2) or (r["mag"] > 27 and r["area"] > 30) or ratio > 5 or new > 1.5
            state[r["source_id"]] = "drop" if r["area"] > 70 else "ignore" if bad else "clean" if new < 1 else "center_only"
    pool = [r for r in rows if (r["clean"] or state.get(r["source_id"]) in ("clean", "center_only")) and r["a"] == r["a"]]
    held = {big["source_id"] for big in pool for small in pool if small["area"] < big["area"] and covered(small, big) >= 0.8}
    want = {i: "ignore" if c in ("clean", "center_only") and i in held else c for i, c in state.items()}
    got = {r.source_id: r["class"] for r in jobs.remeasure_rescue(spark.createDataFrame(rows), ["g"], p).collect()}
    assert got == want and {"drop", "ignore", "clean", "center_only"} <= set(want.values())


def test_labels_of_bright_components(spark):
    """A star in a component, an isolated small and a large source, a blend, a cluster, and an empty component."""
    runs = [("g", y, x0, x0 + w - 1, w, region) for region, x0, y0, w, h in ((1, 10, 10, 8, 8), (2, 40, 10, 6, 6), (3, 60, 60, 9, 9), (4, 80, 10, 9, 9)) for y in range(y0, y0 + h)]
    r = spark.createDataFrame(runs, "g string, y int, x0 int, x1 int, n int, region long")
    s = [
        ("g", 1, 12.0, 12.0, 1.0, 1.0, 0.0, 3.0, 0.0, False),  # in a component with a reliable star
        ("g", 2, 42.0, 12.0, 2.0, 1.0, 0.0, 6.0, 0.0, False),  # alone in a small component
        ("g", 3, 100.0, 100.0, 2.0, 2.0, 0.0, 500.0, 0.0, False),  # outside, large
        ("g", 4, 120.0, 100.0, 2.0, 2.0, 0.0, 500.0, 0.0, True),  # outside, large, a star
        ("g", 5, 140.0, 100.0, 2.0, 2.0, 0.0, 10.0, 0.9, False),  # blended
        ("g", 6, 160.0, 100.0, 2.0, 2.0, 0.0, 10.0, 0.0, False),  # a cluster of two
        ("g", 7, 160.5, 100.0, 2.0, 2.0, 0.0, 10.0, 0.0, False),
        ("g", 8, 180.0, 100.0, 2.0, 2.0, 0.0, 9e9, 0.0, False),  # too large
    ]
    sources = spark.createDataFrame(s, "g string, source_id long, x double, y double, a double, b double, theta double, area double, blendedness double, star boolean")
    stars = spark.createDataFrame([("g", 50, 13.0, 13.0, 15.0, True), ("g", 51, 42.0, 12.0, 15.0, False), ("g", 52, 160.2, 100.0, 15.0, True)], "g string, star_id long, x double, y double, mag double, reliable boolean")
    policy = O.BrightPolicy(isolated_area=100.0, empty_area=50.0)
    rows = O.component_bright_labels(sources, r, stars, ["g"], 300, 300, policy).collect()
    by = {x.id: (x.label, x.reason) for x in rows if x.id is not None}
    assert by[1] == ("restricted", "fragment_of_star") and by[-51] == ("strict", "reliable_star") and by[-53] == ("strict", "reliable_star")
    assert by[2][0] == "clean" and by[3][0] == "weak" and by[4][0] == "center_only" and by[5] == ("ignore", "high_blendedness")
    assert by[6][0] == by[7][0] == "restricted" and by[8] == ("ignore", "large_area")
    assert sorted((x.region, round(x.cx, 1), round(x.cy, 1)) for x in rows if x.id is None) == [(3, 64.0, 64.0), (4, 84.0, 14.0)]


def test_visits_measure_what_only_one_of_them_saw(spark):
    pixels = [("g", x, y, 10.0 + (x * 7 + y * 13) % 5 + (500.0 if (x, y) == (20, 20) else 0.0), False) for x in range(40) for y in range(40)]
    plane = spark.createDataFrame(pixels, "g string, x int, y int, image double, excluded boolean")
    dark = plane.withColumn("image", F.least("image", F.lit(14.0)))
    seen = lambda rows: spark.createDataFrame([("g", i, float(x), float(y)) for i, x, y in rows], "g string, id long, x double, y double")
    rows = W.visit_difference(seen([(1, 5, 5), (2, 20, 20)]), seen([(7, 5, 6), (8, 30, 9)]), 2.0, ["g"], "id", (plane, dark), (2.0, 3.0, 6.0)).collect()
    by = {(r.a, r.b): r for r in rows}
    assert by[1, 7].kind == "common" and by[1, 7].snr_a is None and by[2, None].kind == "only_a" and by[None, 8].kind == "only_b"
    assert by[2, None].snr_a > 20 and by[2, None].trusted_a and abs(by[2, None].snr_b) < 10 and len(rows) == 3
