"""Operators that run in rounds against sequential versions on random points; rule boundaries; odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import jobs, ordinary
from lumenfold.operators import joins as J
from lumenfold.operators import objects as O  # noqa: N812
from lumenfold.operators import pixels as P
from lumenfold.operators import rules as R
from lumenfold.operators import summaries as A
from lumenfold.operators.graph import connected_components


def points(seed, n, size=12.0, start=0):
    rnd = random.Random(seed)
    return [(start + i, round(rnd.uniform(0, size), 3), round(rnd.uniform(0, size), 3), round(rnd.uniform(18, 28), 2), round(rnd.uniform(1, 30), 1)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, source_id long, x double, y double, mag double, area double")


def dist(p, q):
    return math.hypot(p[1] - q[1], p[2] - q[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_match_is_the_sequential_one(spark, seed):
    a, b = points(seed, 60), points(seed + 50, 50, start=1000)
    edges = sorted((dist(p, q), p[0], q[0]) for p in a for q in b if dist(p, q) <= 2.0)
    used, want = set(), set()
    for _, i, j in edges:
        if i not in used and j not in used:
            used |= {i, j}
            want.add((i, j))
    pairs = J.pairs_within(frame(spark, a), frame(spark, b), 2.0, ["g"], "source_id", "source_id")
    assert pairs.count() == len(edges)
    got = [(r.a, r.b) for r in J.greedy_match(pairs, ["g"]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_brighter_of_close_pairs(spark):
    rows = points(3, 70)
    lost = set()
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            if dist(p, q) <= 1.5 and p[0] not in lost and q[0] not in lost:
                lost.add(p[0] if p[3] < q[3] else q[0])
    got = {r.id for r in ordinary.brighter_of_close(frame(spark, rows), 1.5, ["g"]).collect()}
    assert got == lost


def test_priority_dedup_keeps_the_first_of_neighbours(spark):
    rows = points(4, 80)
    kept, want = [], {}
    for p in sorted(rows, key=lambda p: (p[3], p[0])):
        near = [(q[3], q[0]) for q in kept if dist(p, q) <= 1.5]
        if near:
            want[p[0]] = min(near)[1]
        else:
            kept.append(p)
    got = {r.a: r.keep for r in J.priority_dedup(frame(spark, rows), 1.5, ["g"], [F.col("mag")]).collect()}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(40)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[2000 + i] for i in range(40)} == {1000} and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_regions_of_a_mask(spark):
    on = {(0, 0), (1, 0), (1, 1), (5, 5), (6, 5), (5, 6), (9, 9), (3, 2)}
    df = spark.createDataFrame([("g", x, y) for x, y in on], "g string, x int, y int")
    got = sorted((r.area, r.touches_edge) for r in P.component_stats(df, ["g"], 10, 10).collect())
    assert got == [(1, False), (1, True), (3, False), (3, True)]


def test_snr_boundaries(spark):
    rows = spark.createDataFrame([(v,) for v in (4.99, 5.0, 5.01, 6.99, 7.0, 7.01, float("nan"), float("inf"), None)], "snr double")
    got = [r.c for r in rows.select(R.snr_class(F.col("snr"), F.lit(False)).alias("c")).collect()]
    assert got == ["ignore", "ignore", "weak_shape", "weak_shape", "weak_shape", "clean", "ignore", "ignore", "ignore"]
    cls, _ = R.snr_post_filter(F.lit("clean"), F.col("snr"), F.lit(1.0))
    assert [r.c for r in rows.select(cls.alias("c")).collect()] == ["center_only", "clean", "clean", "clean", "clean", "clean", "ignore", "ignore", "ignore"]


def test_weight_ratio_cases(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (1.0, 10.0), (1.0, 5.0), (2.0, 0.0)], "local double, reference double")
    snr, t = E.snr_from_weight_ratio(F.lit(10.0), F.lit(10.0), F.lit(2.0), F.lit(2.0), F.col("local"), F.col("reference"), F.lit(10.0))
    got = rows.select(t.alias("t"), snr.alias("s")).collect()
    assert [r.t for r in got[:3]] == pytest.approx([0.2, 0.1, 0.2]) and math.isnan(got[3].t)
    assert got[0].s == pytest.approx(10 * math.sqrt(0.2)) and math.isnan(got[3].s)


def test_area_rule_boundaries(spark):
    rows = spark.createDataFrame([(900.0, 29.0), (900.1, 29.0), (900.1, 28.0), (900.1, float("nan")), (10000.0, 20.0), (10000.1, 20.0)], "area double, mag double")
    dropped, failed = R.a_rule(F.col("area"), F.col("mag"))
    assert [(r.d, r.f) for r in rows.select(dropped.alias("d"), failed.alias("f")).collect()] == [(False, False), (False, True), (False, False), (False, False), (False, False), (True, False)]


def test_star_evidence_and_missing_columns(spark):
    df = spark.createDataFrame([(3.0, 1.0), (2.9, 1.0), (None, 1.0), (9.0, 0.0)], "parallax double, parallax_error double")
    assert [r.s for r in df.select(E.star_evidence(df).alias("s")).collect()] == [True, False, False, False]


def test_classes_add_up_and_never_rise(spark):
    rows = [(i, *p[1:], "c") for i, p in enumerate(points(9, 120, 40.0))]
    df = spark.createDataFrame(rows, "source_id long, x double, y double, mag double, area double, g string").selectExpr("*", "2D AS a", "1.5D AS b", "0.3D AS theta", "0D AS diff", "0.9D AS fill", "0D AS component", "source_id % 7 > 0 AS valid_kron", "source_id % 5 > 0 AS in_base", "false AS f_edge", "source_id % 11 = 0 AS f_bad")
    got = jobs.classify_sources(df, ["g"]).collect()
    assert len(got) == 120 and {r["class"] for r in got if r.source_id % 5 == 0} == {"outside_base"}
    assert all(r["class"] == "b_ignore" for r in got if r.source_id % 5 and r.source_id % 7 == 0)


def test_strict_metrics_on_empty_sides(spark):
    from lumenfold.operators.windows import strict_point_metrics

    none = frame(spark, []).select("g", F.col("source_id").alias("id"), "x", "y")
    some = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 1.0, 1.0)], "g string, id long, x double, y double")
    r = {x.subset: x for x in strict_point_metrics(none, some, none, 2.0, "g", "id", "id").collect()}
    assert r["base"].targets == 1 and r["base"].purity is None and r["base"].completeness == 0.0
    r = {x.subset: x for x in strict_point_metrics(some, none, some, 2.0, "g", "id", "id").collect()}
    assert r["base"].targets == 0 and r["base"].completeness is None and r["combined"].tp == 1


def test_bins_take_their_lower_edge(spark):
    df = spark.createDataFrame([(20.0,), (20.1,), (20.2,), (20.3,), (float("nan"),), (None,)], "mag double")
    got = {r.mag: r.bin for r in A.binned(df, "mag", 20.0, 21.0, 0.1).collect()}
    edges = [20.0 + i * 0.1 for i in range(11)]
    assert got == {m: max(i for i, e in enumerate(edges) if e <= m) for m in (20.0, 20.1, 20.2, 20.3)}


def test_linked_objects(spark):
    members = spark.createDataFrame([(1, "g", 10), (1, "r", 10), (2, "g", 10), (2, "r", 10), (3, "g", 11), (4, "g", None)], "object long, band string, source_id long")
    targets = spark.createDataFrame([(10, "g"), (10, "r"), (11, "g"), (11, "r")], "source_id long, band string")
    got = {(r.kind, r.pattern): r.n for r in O.link_metrics(members, targets).collect()}
    assert got == {("tp", "gr"): 1, ("fp", "gr"): 1, ("partial", "g"): 1, ("fp", "g"): 1, ("fn", "gr"): 1}
