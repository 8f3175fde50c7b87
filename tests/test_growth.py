"""Steps whose work must grow with the input alone, by their plans, and their rows against plain versions."""

import math
import random
import statistics

from pyspark.sql import functions as F

from lumenfold.operators import objects as O  # noqa: N812
from lumenfold.operators import pixels as P
from lumenfold.operators.ellipses import unit_grid
from lumenfold.plans import registry
from lumenfold.plans.tables import sources

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nested_centers_are_not_made_anew_by_each_reader(spark):
    made = plan(registry.QUERIES["nested_component_centers"](spark, SF))
    assert "l_partkey" not in made and "Window" not in made


def test_nested_centers_of_parents_of_all_sizes(spark):
    rnd = random.Random(5)
    lit = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(500)})
    parents = [(i, float(rnd.randrange(60)), float(rnd.randrange(60)), rnd.choice([0.7, 1.5, 4.0, 9.0, 40.0]), rnd.choice([0.8, 2.0, 5.0, 33.0]), rnd.choice([0.0, 0.6, 2.0])) for i in range(60)]
    centers = [(1000 + i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(40)]
    # Regions by filling, in the order of their first pixels by rows.
    left, regions = set(lit), []
    for x, y in sorted(lit, key=lambda p: (p[1], p[0])):
        if (x, y) in left:
            left.remove((x, y))
            todo, got = [(x, y)], []
            while todo:
                u, v = todo.pop()
                got.append((u, v))
                for q in ((u + 1, v), (u - 1, v), (u, v + 1), (u, v - 1)):
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            regions.append(((y, x), got))

    def holds(p, x, y):
        _, px, py, a, b, t = p
        u, v = math.cos(t) * (x - px) + math.sin(t) * (y - py), -math.sin(t) * (x - px) + math.cos(t) * (y - py)
        return (u / a) ** 2 + (v / b) ** 2 <= 1.0

    found = []
    for first, got in regions:
        inside = [(p[3] * p[4], p[0]) for p in parents if all(holds(p, x, y) for x, y in got)]
        cx, cy = sum(x for x, _ in got) / len(got), sum(y for _, y in got) / len(got)
        if inside and all(math.hypot(cx - x, cy - y) > 2.0 for _, x, y in centers):
            found.append((min(inside)[0], first, min(inside)[1], cx, cy))
    kept = []
    for one in sorted(found):
        if all(math.hypot(one[3] - k[3], one[4] - k[4]) > 2.0 for k in kept):
            kept.append(one)
    pixels = spark.createDataFrame([("v", x, y) for x, y in lit], "band string, x int, y int")
    table = spark.createDataFrame([("v", *p, p[3] * p[4]) for p in parents], "band string, id long, x double, y double, a double, b double, theta double, area double")
    points = spark.createDataFrame([("v", *c) for c in centers], "band string, id long, x double, y double")
    got = O.nested_component_centers(P.regions(pixels, ["band"]), table, points, 2.0, ["band"])
    assert sorted((r.parent, round(r.cx, 6), round(r.cy, 6)) for r in got.collect()) == sorted((k[2], round(k[3], 6), round(k[4], 6)) for k in kept)
    assert len({k[2] for k in kept}) > 5 and len(kept) < len(found)


def test_ellipses_are_dealt_to_tasks_and_far_ones_are_off_the_frame(spark):
    rows = [(0, 3.0, 4.0, 5.0, 5.0, 2.5), (1, 1e12, 5.0, 3.0, 2.0, 0.0), (2, 5.0, -1e12, 3.0, 2.0, 0.0), (3, 22.0, 9.0, 3.5, 1.0, 0.4), (4, -1.5, 9.0, 2.0, 2.0, 0.0), (5, 10.0, 10.0, 1e12, 1e12, 0.0)]
    made = P.rasterize_ellipse(spark.createDataFrame(rows, "id int, cx double, cy double, a double, b double, theta double").coalesce(1), 20, 20)
    assert "Repartition" in plan(made) and "lambda" not in plan(made)
    inside = lambda i, cx, cy, a, b, t, x, y: ((math.cos(t) * (x - cx) + math.sin(t) * (y - cy)) / a) ** 2 + ((-math.sin(t) * (x - cx) + math.cos(t) * (y - cy)) / b) ** 2 <= 1 + 1e-9
    want = sorted((r[0], x, y) for r in rows for x in range(20) for y in range(20) if inside(*r, x, y))
    assert sorted((r.id, r.x, r.y) for r in made.collect()) == want
    assert {i for i, _, _ in want} == {0, 3, 4, 5}


def test_apertures_are_measured_in_tiles_and_not_pixel_by_centre(spark):
    """Planes of several tiles with holes, excluded and broken pixels, equal values, and centres off the frame, between pixels and on the edges of tiles."""
    rnd = random.Random(6)
    image = {(x, y): 2.5 if x < 20 else rnd.choice([rnd.gauss(3, 1), rnd.gauss(3, 1), float("nan"), None]) for x in range(-5, 140) for y in range(60, 72) if rnd.random() < 0.9}
    shut = {q: rnd.random() < 0.1 for q in image}
    places = [(i, float(rnd.randrange(-8, 145)), float(rnd.randrange(56, 76))) for i in range(150)] + [(200, 63.0, 64.0), (201, 64.0, 63.0), (202, 127.5, 64.25), (203, -2.5, 63.75), (204, 500.0, 64.0), (205, 5.0, 66.0)]
    pixels = spark.createDataFrame([("v", x, y, v, shut[x, y]) for (x, y), v in image.items()], "band string, x int, y int, image double, excluded boolean")
    centers = spark.createDataFrame([("v", *p) for p in places], "band string, id long, px double, py double")
    got = {r.id: r for r in P.apertures(centers, pixels, 2.0, 3.0, 6.0, ["band"]).collect()}
    light = {r.id: (r.mean, r.n) for r in P.mean_in_aperture(centers, pixels, 3.0, ["band"]).collect()}
    shaped = centers.selectExpr("*", "3.3D AS a", "1.7D AS b", "0.6D AS theta")
    held = {r.id: (r.total, r.n) for r in P.ellipse_aperture_sum(shaped, pixels, 4, ["band"]).collect()}
    counts = {r.id: r.n for r in P.count_around(centers, pixels, P.disk_offsets(3.5), ["band"]).collect()}
    known = lambda v: v is not None and math.isfinite(v)
    for i, px, py in places:
        near = lambda r, px=px, py=py: [(q, image[q], (q[0] - px) ** 2 + (q[1] - py) ** 2) for q in ((math.trunc(px + dx), math.trunc(py + dy)) for dx, dy in P.disk_offsets(r)) if q in image]
        free = [(v, d) for q, v, d in near(6.0) if known(v) and not shut[q]]
        ap, ann = [v for v, d in free if d <= 4], [v for v, d in free if 9 < d <= 36]
        assert (i in got) == bool(free)
        if free:
            r = got[i]
            assert (r.n_ap, r.n_ann) == (len(ap), len(ann)) and abs(r.s - sum(ap)) < 1e-9
            assert not ann or abs(r.m - statistics.median(ann)) < 1e-12
            assert len(ann) < 2 or abs(r.sd - statistics.stdev(ann)) < 1e-9
            assert len(set(ann)) != 1 or len(ann) < 2 or r.sd == 0.0
        bright = [v for _, v, _ in near(3.0) if known(v) and v > 0]
        assert (i in light) == bool(bright) and (not bright or (abs(light[i][0] - sum(bright) / len(bright)) < 1e-9 and light[i][1] == len(bright)))
        assert counts.get(i, 0) == len(near(3.5))
        if px == int(px) and py == int(py):
            c, s = math.cos(0.6), math.sin(0.6)
            within = [v for (x, y), v in image.items() if known(v) and max(abs(x - px), abs(y - py)) <= 4 and ((c * (x - px) + s * (y - py)) / 3.3) ** 2 + ((c * (y - py) - s * (x - px)) / 1.7) ** 2 <= 1]
            assert (i in held) == bool(within) and (not within or (held[i][1] == len(within) and abs(held[i][0] - sum(within)) < 1e-9))
    assert 204 not in got and any(r.sd == 0.0 for r in got.values())


def test_apertures_do_not_shuffle_a_row_for_each_offset(spark):
    for name in ("aperture_annulus_snr", "mean_in_aperture", "ellipse_aperture_sum", "ap2_snr_measure", "disk_offsets"):
        made = plan(registry.QUERIES[name](spark, SF))
        assert "CoGroup" in made and "explode(array(struct" not in made


def test_centres_and_pixels_may_be_of_one_table(spark):
    """Keys that both sides of a cogroup have from one table are not ambiguous, also where the centres come from a join."""
    one = spark.createDataFrame([("v", 10 * y + x, x, y, float(x + y)) for x in range(10) for y in range(10)], "band string, cell int, x int, y int, image double")
    part = lambda k: one.filter(f"cell % 45 = {k}").select("band", F.col("cell").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    rest = part(0).join(part(1).select("band", "id"), ["band", "id"], "left_anti")
    for pixels in (one, one.select("band", "x", "y", "image")):
        found = P.count_around(rest, pixels, P.disk_offsets(1.0), ["band"])
        assert sorted((r.id, r.n) for r in found.collect()) == [(0, 3), (45, 5), (90, 3)]


def test_isolated_sources_overlap_none_at_any_distance(spark):
    """Ellipses overlap as far as their axes reach: every pair of a band is looked at here."""
    rows = [r.asDict() for r in sources(spark, SF).select("source_id", "band", "x", "y", "a", "b", "theta", "area").collect()]

    def share(s, t):
        c, w, e, z = math.cos(s["theta"]), math.sin(s["theta"]), math.cos(t["theta"]), math.sin(t["theta"])
        at = [(s["x"] + c * s["a"] * u - w * s["b"] * v - t["x"], s["y"] + w * s["a"] * u + c * s["b"] * v - t["y"]) for u, v in unit_grid()]
        return sum(((e * x + z * y) / t["a"]) ** 2 + ((-z * x + e * y) / t["b"]) ** 2 <= 1.0 for x, y in at) / len(at)

    crowded, farthest = set(), 0.0
    for i, s in enumerate(rows):
        for t in rows[:i]:
            d = math.hypot(s["x"] - t["x"], s["y"] - t["y"])
            if s["band"] == t["band"] and d <= max(s["a"], s["b"]) + max(t["a"], t["b"]):
                shared = 0.5 * (share(s, t) * s["area"] + share(t, s) * t["area"])
                if shared / (s["area"] + t["area"] - shared) > 0.05:
                    crowded |= {s["source_id"], t["source_id"]}
                    farthest = max(farthest, d)
    got = {r.source_id: r.isolated for r in registry.QUERIES["isolated_flag"](spark, SF).collect()}
    assert got == {r["source_id"]: r["source_id"] not in crowded for r in rows}
    assert crowded and farthest > 3.0
