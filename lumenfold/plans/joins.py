"""Queries of the joins, matchings, groups and windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import joins as J
from lumenfold.operators import windows as W
from lumenfold.plans.greedy_sql import decided, matching, removal
from lumenfold.plans.registry import query
from lumenfold.plans.tables import detections, read, refit, samples, smag, sources, with_tables

S, SD = "sources", "sources detections"
C = F.col
RADIUS = 3.0


def pairs_sql(left: str, lid: str, right: str, rid: str, radius: float = RADIUS, name: str = "near") -> str:
    """A table of pairs within a radius, in SQL: every pair of a band is looked at."""
    d = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"
    return f"{name} AS (SELECT l.band AS band, l.{lid} AS a, r.{rid} AS b, {d} AS d FROM {left} l JOIN {right} r ON l.band = r.band AND abs(l.x - r.x) <= {radius} AND abs(l.y - r.y) <= {radius} WHERE {d} <= {radius})"


NEAR = pairs_sql("detections", "det_id", "sources", "source_id")
SELF = pairs_sql("sources", "source_id", "sources", "source_id")


def det_pairs(spark, sf):
    return J.pairs_within(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id")


@query("id_align", with_tables("refit sources", "SELECT r.source_id, r.radius AS a_radius, s.flux_err AS b_flux_err FROM refit r JOIN sources s USING (source_id)"))
def id_align(spark, sf):
    return J.id_align(refit(spark, sf).select("source_id", "file_order", "radius"), sources(spark, sf).selectExpr("source_id", "c AS file_order", "flux_err"), "source_id", "file_order").select("source_id", "a_radius", "b_flux_err")


@query("scan_refit_last_row", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 40 > 0 GROUP BY o_custkey")
def scan_refit_last_row(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus <> 'P' AND o_orderkey % 40 > 0").select("o_custkey", "o_orderkey")
    return J.last_by(o, "o_custkey", "o_orderkey")


@query("id_exclude", with_tables("refit sources", "SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM refit WHERE NOT good)"))
def id_exclude(spark, sf):
    return J.id_exclude(sources(spark, sf), refit(spark, sf).filter("NOT good"), "source_id").select("source_id")


@query("close_pairs", with_tables(S, "SELECT band, a, b, round(d, 6) AS d FROM near WHERE a < b", SELF))
def close_pairs(spark, sf):
    return J.close_pairs(sources(spark, sf), RADIUS, ["band"], "source_id").select("band", "a", "b", F.round("d", 6).alias("d"))


@query("within_any_radius", with_tables(SD, "SELECT DISTINCT a AS det_id FROM near", NEAR))
def within_any_radius(spark, sf):
    return J.within_any_radius(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id").select("det_id")


@query("nearest_within", with_tables(SD, "SELECT band, a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM near) WHERE n = 1", NEAR))
def nearest_within(spark, sf):
    return J.nearest_within(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id").select("band", "a", "b", F.round("d", 6).alias("d"))


_MUTUAL = "mutual AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM near) WHERE ra = 1 AND rb = 1)"


@query("mutual_nearest_match", with_tables(SD, "SELECT band, a, b, round(d, 6) AS d FROM mutual", NEAR, _MUTUAL))
def mutual_nearest_match(spark, sf):
    return J.mutual_nearest_match(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id").select("band", "a", "b", F.round("d", 6).alias("d"))


@query("greedy_match", with_tables(SD, "SELECT band, a, b, round(d, 6) AS d FROM taken", NEAR, matching("taken", "near")))
def greedy_match(spark, sf):
    return J.greedy_match(det_pairs(spark, sf), ["band"]).select("band", "a", "b", F.round("d", 6).alias("d"))


@query("greedy_match_nearest", with_tables(SD, "SELECT band, a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) AS m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM near) WHERE n = 1) WHERE m = 1", NEAR))
def greedy_match_nearest(spark, sf):
    return J.greedy_match_nearest(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id").select("band", "a", "b", F.round("d", 6).alias("d"))


_STAGES = matching("one", "(SELECT * FROM near WHERE b % 3 > 0)"), matching("two", "(SELECT * FROM near n WHERE b % 3 = 0 AND NOT EXISTS (SELECT 1 FROM one o WHERE o.band = n.band AND o.a = n.a))")


@query("two_stage_match", with_tables(SD, "SELECT band, a, b, 1::INT AS stage FROM one UNION ALL SELECT band, a, b, 2::INT FROM two", NEAR, *_STAGES))
def two_stage_match(spark, sf):
    s = sources(spark, sf)
    return J.two_stage_match(detections(spark, sf), s.filter("source_id % 3 > 0"), s.filter("source_id % 3 = 0"), RADIUS, ["band"], "det_id", "source_id").select("band", "a", "b", "stage")


_SETS = "of_base AS (SELECT band, min(source_id) AS b FROM sources WHERE source_id % 3 > 0 GROUP BY band, x, y), of_all AS (SELECT band, min(source_id) AS b FROM sources GROUP BY band, x, y)"


def _metrics(subset: str, targets: str, taken: str) -> str:
    counts = f"SELECT band, coalesce(t.n, 0) AS targets, coalesce(p.n, 0) AS predictions, coalesce(m.n, 0) AS tp FROM (SELECT band, count(*) AS n FROM {targets} GROUP BY band) t FULL JOIN (SELECT band, count(*) AS n FROM detections GROUP BY band) p USING (band) LEFT JOIN (SELECT band, count(*) AS n FROM {taken} GROUP BY band) m USING (band)"
    return f"SELECT band, '{subset}' AS subset, targets, predictions, tp, CASE WHEN targets > 0 THEN tp / targets END AS completeness, CASE WHEN predictions > 0 THEN tp / predictions END AS purity FROM ({counts})"


@query("strict_point_metrics", with_tables(SD, _metrics("base", "of_base", "taken_base") + " UNION ALL " + _metrics("combined", "of_all", "taken_all"), NEAR, _SETS, matching("taken_base", "(SELECT n.* FROM near n JOIN of_base USING (b))"), matching("taken_all", "(SELECT n.* FROM near n JOIN of_all USING (b))")))
def strict_point_metrics(spark, sf):
    s = sources(spark, sf)
    return W.strict_point_metrics(detections(spark, sf), s.filter("source_id % 3 > 0"), s.filter("source_id % 3 = 0"), RADIUS, "band", "det_id", "source_id")


_TILES = "tiles AS (SELECT 'p' || patch || '_r' || r || '_c' || q AS name, (patch * 2048 + q * 300)::DOUBLE AS x0, (r * 300)::DOUBLE AS y0, 400 AS size FROM (SELECT DISTINCT patch FROM sources) CROSS JOIN (SELECT unnest(range(3)) AS r) CROSS JOIN (SELECT unnest(range(3)) AS q))"


def tiles(s):
    """Nine overlapping tiles in each patch of sources."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")
    return s.select("patch").distinct().select("patch", grid).selectExpr("concat('p', patch, '_r', k div 3, '_c', k % 3) AS name", "CAST(patch * 2048 + k % 3 * 300 AS DOUBLE) AS x0", "CAST(k div 3 * 300 AS DOUBLE) AS y0", "400 AS size")


@query("source_in_tile", with_tables(S, "SELECT source_id, name, x - x0 AS lx, y - y0 AS ly FROM sources JOIN tiles ON x >= x0 - 5 AND x < x0 + size + 5 AND y >= y0 - 5 AND y < y0 + size + 5", _TILES))
def source_in_tile(spark, sf):
    return J.source_in_tile(sources(spark, sf), tiles(sources(spark, sf)), 5.0).select("source_id", "name", "lx", "ly")


_GRID = "grid AS (SELECT u, v FROM (SELECT unnest([-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS u) CROSS JOIN (SELECT unnest([-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS v) WHERE u * u + v * v <= 1.0)"


def _cover(s: str, d: str) -> str:
    px, py = f"({s}.x + cos({s}.theta) * ({s}.a * u) - sin({s}.theta) * ({s}.b * v) - {d}.x)", f"({s}.y + sin({s}.theta) * ({s}.a * u) + cos({s}.theta) * ({s}.b * v) - {d}.y)"
    p, q = f"((cos({d}.theta) * {px} + sin({d}.theta) * {py}) / {d}.a)", f"((-sin({d}.theta) * {px} + cos({d}.theta) * {py}) / {d}.b)"
    return f"(SELECT count(*) FILTER (WHERE {p} * {p} + {q} * {q} <= 1.0)::DOUBLE / count(*) FROM grid)"


_OVER = f"""covered AS (SELECT n.band, n.a, n.b, n.d, {_cover('s', 't')} AS in_b, {_cover('t', 's')} AS in_a, s.area AS a_area, t.area AS b_area
FROM near n JOIN sources s ON s.source_id = n.a JOIN sources t ON t.source_id = n.b WHERE n.a < n.b),
ious AS (SELECT *, least(greatest(0.5::DOUBLE * (in_b * a_area + in_a * b_area) / (a_area + b_area - 0.5::DOUBLE * (in_b * a_area + in_a * b_area)), 0), 1) AS iou FROM covered)"""


@query("ellipse_overlap_join", with_tables(S, "SELECT a, b, round(iou, 6) AS iou FROM ious", SELF, _GRID, _OVER))
def ellipse_overlap_join(spark, sf):
    return J.ellipse_overlap_join(sources(spark, sf), RADIUS, ["band"]).select("a", "b", F.round("iou", 6).alias("iou"))


@query("ellipse_contains_join", with_tables(S, "SELECT a, b, round(in_a, 6) AS in_a, round(in_b, 6) AS in_b FROM ious", SELF, _GRID, _OVER))
def ellipse_contains_join(spark, sf):
    return J.ellipse_overlap_join(sources(spark, sf), RADIUS, ["band"]).select("a", "b", F.round("in_a", 6).alias("in_a"), F.round("in_b", 6).alias("in_b"))


#: Ellipses here have axes of at most 10, so circles that touch are at most 20 apart.
_TOUCHING = pairs_sql("sources", "source_id", "sources", "source_id", 20.0, "within20"), "near AS (SELECT n.* FROM within20 n JOIN sources s ON s.source_id = n.a JOIN sources t ON t.source_id = n.b WHERE n.a < n.b AND n.d <= greatest(s.a, s.b) + greatest(t.a, t.b))"
_HELD = "held AS (SELECT a, b, CASE WHEN a_area <= b_area THEN b ELSE a END AS loser FROM ious WHERE CASE WHEN a_area <= b_area THEN in_b ELSE in_a END >= 0.4)"


@query("containment_removal", with_tables(S, "SELECT id FROM removed", *_TOUCHING, _GRID, _OVER, _HELD, removal("removed", "held")))
def containment_removal(spark, sf):
    s = sources(spark, sf)
    return J.containment_losers(J.ellipse_overlap_join(s, None, ["band"]), 0.4)


_M = smag("flux")


@query("close_pair_dedup", with_tables(S, "SELECT DISTINCT CASE WHEN ma > mb OR (ma = mb AND aa >= ab) THEN a ELSE b END AS source_id FROM (SELECT n.a, n.b, s.area AS aa, t.area AS ab, CASE WHEN isnan(s.mag) THEN 'inf'::DOUBLE ELSE s.mag END AS ma, CASE WHEN isnan(t.mag) THEN 'inf'::DOUBLE ELSE t.mag END AS mb FROM near n JOIN m s ON s.source_id = n.a JOIN m t ON t.source_id = n.b WHERE n.a < n.b)", SELF, f"m AS (SELECT *, {_M} AS mag FROM sources)"))
def close_pair_dedup(spark, sf):
    return J.close_pair_losers(sources(spark, sf).withColumn("mag", E.flux_to_mag("flux")), RADIUS, ["band"])


_PLACES = """places AS MATERIALIZED (SELECT source_id, row_number() OVER (ORDER BY source_id % 4, -kron_flux, area, source_id) AS k FROM sources),
ordered AS MATERIALIZED (SELECT l.k AS later, e.k AS earlier, n.a, n.b, n.d FROM near n JOIN places l ON l.source_id = n.a JOIN places e ON e.source_id = n.b WHERE e.k < l.k)"""


@query("priority_dedup", with_tables(S, "SELECT a, min_by(b, earlier) AS keep, round(min_by(d, earlier), 6) AS d FROM ordered JOIN final ON final.k = earlier WHERE s = 1 AND later IN (SELECT k FROM final WHERE s = 2) GROUP BY a", SELF, _PLACES, decided("final", "ordered")))
def priority_dedup(spark, sf):
    s = sources(spark, sf)
    return J.priority_dedup(s, RADIUS, ["band"], [C("source_id") % 4, -C("kron_flux"), C("area")]).select("a", "keep", F.round("d", 6).alias("d"))


_REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"


def _inside(e: str) -> str:
    u, v = f"((cos({e}.theta) * (gx - {e}.x) + sin({e}.theta) * (gy - {e}.y)) / {e}.a)", f"((-sin({e}.theta) * (gx - {e}.x) + cos({e}.theta) * (gy - {e}.y)) / {e}.b)"
    return f"({u} * {u} + {v} * {v} <= 1.0 + 1e-9)"


#: IoU on whole pixels of pairs whose circles touch, in SQL; no box here is wider than 512.
_PIXEL_IOU = f"""touching AS (SELECT n.a, n.b, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty, greatest(s.a, s.b) AS sr, greatest(t.a, t.b) AS tr FROM near n JOIN sources s ON s.source_id = n.a JOIN sources t ON t.source_id = n.b WHERE n.a < n.b AND s.area < 1200 AND t.area < 1200 AND n.d <= greatest(s.a, s.b) + greatest(t.a, t.b)),
columns_of AS (SELECT a, b, sy, ty, sr, tr, unnest(range(floor(least(sx - sr, tx - tr))::BIGINT, ceil(greatest(sx + sr, tx + tr))::BIGINT + 1)) AS gx FROM touching),
cells_of AS (SELECT a, b, gx, unnest(range(floor(least(sy - sr, ty - tr))::BIGINT, ceil(greatest(sy + sr, ty + tr))::BIGINT + 1)) AS gy FROM columns_of),
pixel_ious AS (SELECT c.a, c.b, count(*) FILTER (WHERE {_inside('s')} AND {_inside('t')})::DOUBLE / nullif(count(*) FILTER (WHERE {_inside('s')} OR {_inside('t')}), 0) AS iou FROM cells_of c JOIN sources s ON s.source_id = c.a JOIN sources t ON t.source_id = c.b GROUP BY c.a, c.b)"""


@query("cluster_sources", with_tables(S, "SELECT s.source_id, least(s.source_id, coalesce(min(r.b), s.source_id)) AS cluster FROM sources s LEFT JOIN reach r ON r.a = s.source_id GROUP BY s.source_id", SELF, _PIXEL_IOU, "links AS (SELECT a, b FROM pixel_ious WHERE iou >= 0.05 UNION SELECT b, a FROM pixel_ious WHERE iou >= 0.05)", _REACH))
def cluster_sources(spark, sf):
    return J.cluster_sources(sources(spark, sf), ["band"], 0.05, 1200.0, RADIUS)


@query("connected_components", with_tables(S, "SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a", SELF, "links AS (SELECT a, b FROM near WHERE a <> b)", _REACH))
def connected_components(spark, sf):
    from lumenfold.operators.graph import connected_components as components

    return components(J.close_pairs(sources(spark, sf), RADIUS, ["band"], "source_id").select("a", "b"))


_BANDS = ["click", "error", "purchase", "signup", "view"]


_BAND_LIST = "['click', 'error', 'purchase', 'signup', 'view']"


def linked_sql(radius: float) -> str:
    """Table linked (id, band, place, object): mutual nearest neighbours of adjacent bands, chained, in SQL."""
    d = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"
    return f"""placed AS MATERIALIZED (SELECT source_id, x, y, list_position({_BAND_LIST}, band) AS place FROM sources),
adjacent AS (SELECT l.source_id AS a, r.source_id AS b, {d} AS d FROM placed l JOIN placed r ON r.place = l.place + 1 AND abs(l.x - r.x) <= {radius} AND abs(l.y - r.y) <= {radius} WHERE {d} <= {radius}),
chosen AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM adjacent) WHERE ra = 1 AND rb = 1),
links AS MATERIALIZED (SELECT a, b FROM chosen UNION SELECT b, a FROM chosen), {_REACH},
linked AS (SELECT s.source_id AS id, s.band, list_position({_BAND_LIST}, s.band) AS place, least(s.source_id, coalesce(min(r.b), s.source_id)) AS object FROM sources s LEFT JOIN reach r ON r.a = s.source_id GROUP BY s.source_id, s.band)"""


@query("band_link", with_tables(S, "SELECT id, object, row_number() OVER (PARTITION BY object ORDER BY CASE WHEN place = 3 THEN 0 ELSE place END, id) = 1 AS reference FROM linked", linked_sql(RADIUS)))
def band_link(spark, sf):
    points = sources(spark, sf).selectExpr("source_id AS id", "band", "x", "y", "1 AS one")
    return J.band_link(points, _BANDS, RADIUS, ["one"])


@query("merge_close_by_score", with_tables(S, "SELECT id, members FROM (SELECT source_id AS id, count(*) OVER (PARTITION BY g) AS members, row_number() OVER (PARTITION BY g ORDER BY -c, source_id) AS n FROM (SELECT s.source_id, s.c, least(s.source_id, coalesce(min(r.b), s.source_id)) AS g FROM sources s LEFT JOIN reach r ON r.a = s.source_id GROUP BY 1, 2)) WHERE n = 1", SELF, "links AS (SELECT a, b FROM near WHERE a <> b AND d < 3.0)", _REACH))
def merge_close_by_score(spark, sf):
    return J.merge_close_by_score(sources(spark, sf).selectExpr("source_id AS id", "band", "x", "y", "c AS score"), RADIUS, ["band"])


@query("parent_child_cascade", with_tables(S, "SELECT source_id, CASE WHEN n_child > 0 THEN kids ELSE 0 END::INT AS n_child FROM (SELECT r.*, (SELECT count(*) FROM rest k WHERE k.parent = r.source_id AND k.parent <> 0) AS kids FROM rest r) WHERE NOT (n_child > 0 AND kids = 0)", "rest AS (SELECT * FROM sources WHERE c % 7 >= 3 AND parent NOT IN (SELECT source_id FROM sources WHERE c % 7 < 3))"))
def parent_child_cascade(spark, sf):
    return J.parent_child_cascade(sources(spark, sf), C("c") % 7 < 3).select("source_id", "n_child")


@query("replay_check", with_tables(S, "SELECT source_id, 'missing' AS problem FROM sources WHERE source_id % 40 = 0 UNION ALL SELECT source_id, 'band' FROM sources WHERE source_id % 33 = 1 AND source_id % 40 <> 0 UNION ALL SELECT source_id, 'x' FROM sources WHERE source_id % 21 = 2 AND source_id % 40 <> 0"))
def replay_check(spark, sf):
    s = sources(spark, sf)
    fresh = s.filter("source_id % 40 <> 0").withColumns({"band": F.when(C("source_id") % 33 == 1, "other").otherwise(C("band")), "x": F.when(C("source_id") % 21 == 2, C("x") + 0.5).otherwise(C("x") + 1e-9)})
    return J.replay_check(s, fresh, "source_id", ["band"], {"x": 1e-6})


@query("predictions_vs_kept_gt", with_tables(SD, "SELECT det_id, EXISTS (SELECT 1 FROM sources s WHERE s.source_id = det_id AND s.band = d.band AND s.area > 500) AS matched FROM detections d"))
def predictions_vs_kept_gt(spark, sf):
    kept = sources(spark, sf).filter("area > 500").selectExpr("source_id AS det_id", "band")
    return J.flagged_matches(detections(spark, sf), kept, ["det_id", "band"]).select("det_id", "matched")


@query("selector_expand", with_tables("samples", "SELECT DISTINCT sample_id, alias FROM (SELECT sample_id, unnest([source || ':' || patch, source || ':' || patch || '@' || grp, source || ':*']) AS alias FROM samples) WHERE alias IN (SELECT source || ':' || patch || '@1' FROM samples WHERE sample_id % 10 = 0) OR alias IN ('Brand#2:*')"))
def selector_expand(spark, sf):
    s = samples(spark, sf)
    wanted = s.filter("sample_id % 10 = 0").selectExpr("concat(source, ':', patch, '@1') AS alias").unionByName(spark.createDataFrame([("Brand#2:*",)], "alias string"))
    return W.selector_expand(s, wanted)


@query("selector_random_group", with_tables("samples", "SELECT source, patch, grp FROM (SELECT source, patch, grp, row_number() OVER (PARTITION BY source, patch ORDER BY sha256('5:' || source || ':' || patch || ':' || grp)) AS n FROM (SELECT DISTINCT source, patch, grp FROM samples)) WHERE n = 1"))
def selector_random_group(spark, sf):
    return W.random_group(samples(spark, sf), seed=5)


@query("split_guard", with_tables("samples", "SELECT t.sample_id FROM samples t WHERE t.sample_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM samples v WHERE v.sample_id % 50 = 0 AND ((v.source = t.source AND v.patch = t.patch) OR (abs(v.bx - t.bx) < 512 AND abs(v.by - t.by) < 512 AND v.source = t.source)))"))
def split_guard(spark, sf):
    s = samples(spark, sf)
    return W.split_guard(s.filter("sample_id % 5 <> 0"), s.filter("sample_id % 50 = 0"), size=0.0, pad=256.0).select("sample_id")


#: Clusters of sources by user, and one detection in seven as a star.
_GAIA = f"""members AS (SELECT band, user_id AS cluster, x, y FROM sources), stars AS (SELECT band, det_id, x, y FROM detections WHERE det_id % 7 = 0),
centers AS (SELECT band, cluster, avg(x) AS x, avg(y) AS y FROM members GROUP BY ALL),
{pairs_sql('stars', 'det_id', 'members', 'cluster', 4.0, 'by_member')}, {pairs_sql('stars', 'det_id', 'centers', 'cluster', 60.0, 'by_center')},
candidates AS (SELECT band, a, b, CASE WHEN min(k) = 0 THEN 'source_center' ELSE 'cluster_centroid' END AS mode, CASE WHEN min(k) = 0 THEN min(d) FILTER (WHERE k = 0) ELSE min(d) END AS d
  FROM (SELECT band, a, b, d, 0 AS k FROM by_member UNION ALL SELECT band, a, b, d, 1 FROM by_center) GROUP BY band, a, b)"""


def _candidates(spark, sf):
    members = sources(spark, sf).select("band", C("user_id").alias("cluster"), "x", "y")
    stars = detections(spark, sf).filter("det_id % 7 = 0").withColumnRenamed("det_id", "star_id")
    return W.stars_near_clusters(members, stars, 4.0, 60.0, ["band"])


@query("gaia_to_cluster", with_tables(SD, "SELECT band, a AS star_id, b AS cluster, mode, round(d, 6) AS d FROM candidates", _GAIA))
def gaia_to_cluster(spark, sf):
    return _candidates(spark, sf).withColumn("d", F.round("d", 6))


@query("gaia_assign", with_tables(SD, "SELECT band, star_id, cluster, mode FROM (SELECT band, a AS star_id, b AS cluster, mode, row_number() OVER (PARTITION BY band, a ORDER BY round(d, 9), b) AS k FROM candidates) WHERE k = 1", _GAIA))
def gaia_assign(spark, sf):
    return W.assign_stars(_candidates(spark, sf).withColumn("d", F.round("d", 9)), ["band"]).select("band", "star_id", "cluster", "mode")


@query("rank_in_side", with_tables(SD, "SELECT a, b, row_number() OVER (PARTITION BY band, a ORDER BY d, a, b) AS ra, row_number() OVER (PARTITION BY band, b ORDER BY d, a, b) AS rb FROM near", NEAR))
def rank_in_side(spark, sf):
    return J.rank_in_side(det_pairs(spark, sf), ["band"]).select("a", "b", "ra", "rb")


@query("frame_by_rank_or_visit", "SELECT user_id, max(event_id) FILTER (WHERE r = least(3, n)) AS third, max(event_id) FILTER (WHERE r = greatest(n - 1, 1)) AS before_last, min(event_id) FILTER (WHERE event_type = 'view' AND v = 1) AS first_view FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS v FROM events) GROUP BY user_id")
def frame_by_rank_or_visit(spark, sf):
    e = read(spark, sf, "events").selectExpr("user_id AS tile", "event_type AS visit", "ts", "event_id")
    at = lambda rank: W.frame_at_rank(e, rank).select("tile", "event_id")
    out = at(2).withColumnRenamed("event_id", "third").join(at(-2).withColumnRenamed("event_id", "before_last"), "tile", "left").join(W.frame_of_visit(e, "view").selectExpr("tile", "event_id AS first_view"), "tile", "left")
    return out.withColumnRenamed("tile", "user_id")


@query("brightest_member", with_tables(S, "SELECT user_id, source_id FROM (SELECT user_id, source_id, row_number() OVER (PARTITION BY user_id ORDER BY kron_flux DESC, source_id) AS n FROM sources) WHERE n = 1"))
def brightest_member(spark, sf):
    return J.brightest_member(sources(spark, sf), "user_id", "kron_flux")


_RUNS = "runs AS (SELECT band, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY band, y ORDER BY x) AS k FROM pixels WHERE (mask & 1) <> 0) GROUP BY band, y, k)"


@query("row_runs", with_tables("pixels", "SELECT band, y, x0, x1, n FROM runs", _RUNS))
def row_runs(spark, sf):
    from lumenfold.operators import pixels as P
    from lumenfold.plans.tables import pixels

    return P.row_runs(pixels(spark, sf).filter(E.mask_bit(C("mask"), 0)), ["band"])


@query("track_length", "SELECT event_id, count(DISTINCT ts::DATE) OVER (PARTITION BY user_id) AS frames FROM events")
def track_length(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("t"))
    return W.track_length(e, "user_id", "t").select("event_id", "frames")


@query("isolated_flag", with_tables(S, "SELECT source_id, coalesce(max(m), 0) <= 0.05 AS isolated FROM sources LEFT JOIN (SELECT a AS source_id, iou AS m FROM ious UNION ALL SELECT b, iou FROM ious) USING (source_id) GROUP BY source_id", *_TOUCHING, _GRID, _OVER))
def isolated_flag(spark, sf):
    return J.isolated_flag(sources(spark, sf), ["band"], 0.05)


_N = 16
_TURN = math.pi * (3.0 - math.sqrt(5.0))
_RP = f"sqrt((k + 0.5::DOUBLE) / {_N})", f"(k * {_TURN!r}::DOUBLE)"


@query("disk_samples", with_tables(S, "SELECT source_id, k, round(x + cos(theta) * u - sin(theta) * v, 6) AS px, round(y + sin(theta) * u + cos(theta) * v, 6) AS py FROM samples_of", f"samples_of AS (SELECT *, {_RP[0]} * cos({_RP[1]}) * a AS u, {_RP[0]} * sin({_RP[1]}) * b AS v FROM (SELECT *, unnest(range({_N})) AS k FROM sources))"))
def disk_samples(spark, sf):
    return W.disk_samples(sources(spark, sf), _N).select("source_id", "k", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))
