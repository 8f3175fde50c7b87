"""Queries of the user-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import jobs
from lumenfold.operators import joins as J
from lumenfold.operators import objects as O  # noqa: N812
from lumenfold.operators import ordinary
from lumenfold.operators import pixels as P
from lumenfold.operators import rules as R
from lumenfold.operators import summaries as A
from lumenfold.operators import windows as W
from lumenfold.plans.greedy_sql import decided, matching, removal
from lumenfold.plans.joins import _GRID, _OVER, _PIXEL_IOU, _REACH, _TOUCHING, NEAR, linked_sql, pairs_sql
from lumenfold.plans.registry import query
from lumenfold.plans.rules import _RICH_SQL, rich
from lumenfold.plans.summaries import _FREE, BINS, BY_BIN, _clipped, kron_sql
from lumenfold.plans.tables import detections, out, pixels, samples, sfin, sources, sout, weights, with_tables
from lumenfold.session import stash

C = F.col


def full(spark, sf):
    """The sources with everything that the classifiers look at."""
    s = rich(spark, sf)
    return s.withColumns({"in_base": C("n_child") == 0, "valid_kron": C("source_id") % 37 > 0, "warn": C("source_id") % 20, "star_mask": C("source_id") % 29 == 0, "model_mag": C("mag") + C("xy"), "center_ok": C("source_id") % 43 > 0})


#: The classifier's columns, then close pairs, then ellipses that hold smaller ones.
_CLASSES = f"""based AS (SELECT *, n_child = 0 AS base, source_id % 37 > 0 AS good, {sfin('mag')} AND mag < 22 AS bright, {sfin('mag')} AND mag > 28 AND area > 900 AS faint, {sfin('diff')} AND abs(diff) >= CASE WHEN component = 0 THEN 1 WHEN component < 1000 THEN 2 ELSE 'inf'::DOUBLE END AS apart FROM rich),
kept AS (SELECT *, base AND good AND faint AS failed, bright AND apart AS is_hard FROM based),
hollowed AS (SELECT *, base AND good AND NOT failed AND area > 500 AND fill < 0.3 AND NOT is_hard AS hollow FROM kept),
tried AS (SELECT *, base AND good AND NOT failed AND NOT hollow AS cand FROM hollowed),
ruled AS MATERIALIZED (SELECT *, cand AND (is_hard OR ratio > 6 OR (NOT bright AND (NOT ({sfin('mag')} AND mag BETWEEN 22 AND 28) OR NOT ({sfin('diff')} AND abs(diff) < 1) OR f_edge OR f_bad))) AS removed, CASE WHEN isnan(mag) THEN 'inf'::DOUBLE ELSE mag END AS m FROM tried),
close AS MATERIALIZED (SELECT DISTINCT CASE WHEN s.m > t.m OR (s.m = t.m AND s.area >= t.area) THEN n.a ELSE n.b END AS id FROM near n JOIN ruled s ON s.source_id = n.a JOIN ruled t ON t.source_id = n.b WHERE n.a < n.b AND n.d <= 3 AND s.cand AND NOT s.removed AND t.cand AND NOT t.removed),
rest AS MATERIALIZED (SELECT source_id FROM ruled WHERE cand AND NOT bright AND NOT removed AND source_id NOT IN (SELECT id FROM close)),
held AS MATERIALIZED (SELECT a, b, CASE WHEN a_area <= b_area THEN b ELSE a END AS loser FROM ious WHERE a IN (SELECT source_id FROM rest) AND b IN (SELECT source_id FROM rest) AND CASE WHEN a_area <= b_area THEN in_b ELSE in_a END >= 0.8)"""
_CLASS_ROWS = """SELECT source_id, CASE WHEN cand AND NOT lost THEN 'clean' WHEN hollow THEN 'center_only' WHEN base AND NOT good THEN 'b_ignore' WHEN failed THEN 'a_failed' WHEN cand THEN 'b_ignore' ELSE 'outside_base' END AS class,
  array_to_string(list_sort(list_filter([CASE WHEN failed THEN 'A_faint_large' END, CASE WHEN hollow THEN 'center_only_fill' END, CASE WHEN cand AND is_hard THEN 'B_bright_ap2_kron' END, CASE WHEN is_close THEN 'B_close_center_fainter' END, CASE WHEN holds THEN 'B_large_contains_small' END, CASE WHEN base AND NOT good THEN 'invalid_kron' END, CASE WHEN cand AND lost THEN 'removed_by_B' END, CASE WHEN removed AND f_edge THEN 'f_edge' END, CASE WHEN removed AND f_bad THEN 'f_bad' END], lambda r: r IS NOT NULL)), ';') AS reason
FROM (SELECT *, removed OR is_close OR holds AS lost FROM (SELECT *, source_id IN (SELECT id FROM close) AS is_close, source_id IN (SELECT id FROM holders) AS holds FROM ruled))"""


@query("classify_sources", with_tables("sources", _CLASS_ROWS, _RICH_SQL, *_TOUCHING, _GRID, _OVER, _CLASSES, removal("holders", "held")))
def classify_sources(spark, sf):
    return jobs.classify_sources(full(spark, sf), ["band"])


#: In the order in which the first that holds decides; centres without data come first.
_BASICS = f"""basics AS MATERIALIZED (SELECT *, CASE WHEN source_id % 43 = 0 THEN 'center_no_data' WHEN n_child <> 0 THEN 'source_filter' WHEN source_id % 37 = 0 OR NOT {sfin('mag')} OR area <= 0 THEN 'invalid'
  WHEN area > 10000 THEN 'A_area_gt_max' WHEN area > 900 AND mag > 28 THEN 'A_faint_large' WHEN mag > 30 THEN 'B_mag_gt_max' WHEN ratio > 6 THEN 'B_axis_ratio' ELSE '' END AS why FROM rich),
good AS MATERIALIZED (SELECT * FROM basics WHERE why = ''),
meetings AS MATERIALIZED (SELECT n.a, n.b, s.mag >= t.mag AS first_loses FROM near n JOIN good s ON s.source_id = n.a JOIN good t ON t.source_id = n.b WHERE n.a < n.b AND n.d < 3),
forward AS MATERIALIZED (SELECT b AS later, a AS earlier FROM meetings WHERE NOT first_loses)"""


@query("classify_basics", with_tables("sources", """SELECT source_id, CASE WHEN lost THEN 'ignore' WHEN why IN ('source_filter', 'A_area_gt_max', 'A_faint_large') THEN 'dropped' WHEN why <> '' THEN 'ignore' WHEN mag < 22 THEN 'bright' ELSE 'ordinary' END AS class, CASE WHEN lost THEN 'B_close_pair_dimmer' ELSE why END AS reason
FROM (SELECT *, source_id IN (SELECT k FROM turn WHERE s = 2) OR source_id IN (SELECT a FROM meetings WHERE first_loses AND a NOT IN (SELECT k FROM turn WHERE s = 2)) AS lost FROM basics)""", _RICH_SQL, pairs_sql("sources", "source_id", "sources", "source_id"), _BASICS, decided("turn", "forward")))
def classify_basics(spark, sf):
    return jobs.classify_basics(full(spark, sf), ["band"])


@query("label_ordinary_hsc")
def label_ordinary_hsc(spark, sf):
    return ordinary.label_ordinary_hsc(full(spark, sf), ["band"], C("band") == "view")


#: 72 places on the rim of the smaller ellipse and its centre, with a tolerance, in the larger one.
_RIM = "rim AS MATERIALIZED (SELECT cos(2 * pi() * i / 72) AS u, sin(2 * pi() * i / 72) AS v FROM (SELECT unnest(range(72)) AS i) UNION ALL SELECT 0, 0)"
_COSMOS = f"""started AS MATERIALIZED (SELECT *, abs(mag - (mag + xy)) AS apart, CASE WHEN source_id % 43 = 0 THEN 'ignore:center_no_data' WHEN area <= 0 THEN 'ignore:invalid_geometry' WHEN source_id % 20 IN (1, 4, 5, 6) THEN 'ignore:warn'
  WHEN NOT ({sfin('mag')} AND mag < 90 AND mag + xy < 90) OR abs(mag - (mag + xy)) > 2 THEN 'ignore:photometry' WHEN source_id % 29 = 0 THEN 'strict:star_mask' WHEN abs(mag - (mag + xy)) >= 1 THEN 'strict:photometry' ELSE 'clean:' END AS first FROM rich),
active AS MATERIALIZED (SELECT * FROM started WHERE first NOT LIKE 'ignore%' AND {sfin('snr')} AND snr > 5),
sized AS (SELECT n.a, n.b, CASE WHEN s.area <= t.area THEN n.a ELSE n.b END AS inner_id, CASE WHEN s.area <= t.area THEN n.b ELSE n.a END AS loser FROM near n JOIN active s ON s.source_id = n.a JOIN active t ON t.source_id = n.b),
nested AS MATERIALIZED (SELECT z.a, z.b, z.loser FROM sized z JOIN active i ON i.source_id = z.inner_id JOIN active o ON o.source_id = z.loser JOIN rim ON true GROUP BY z.a, z.b, z.loser
  HAVING count(*) FILTER (WHERE pow((cos(o.theta) * (i.x + cos(i.theta) * (i.a * u) - sin(i.theta) * (i.b * v) - o.x) + sin(o.theta) * (i.y + sin(i.theta) * (i.a * u) + cos(i.theta) * (i.b * v) - o.y)) / o.a, 2) + pow((-sin(o.theta) * (i.x + cos(i.theta) * (i.a * u) - sin(i.theta) * (i.b * v) - o.x) + cos(o.theta) * (i.y + sin(i.theta) * (i.a * u) + cos(i.theta) * (i.b * v) - o.y)) / o.b, 2) <= 1.001) >= 0.995 * count(*))"""
#: Labels only fall, and the first of equal ones stays.
_COSMOS_ROWS = f"""SELECT source_id, split_part(final, ':', 1) AS class, split_part(final, ':', 2) AS reason FROM (SELECT *, CASE WHEN first LIKE 'ignore%' THEN first WHEN NOT ({sfin('snr')} AND snr > 5) THEN 'ignore:snr_ignore' WHEN first LIKE 'strict%' THEN first
  WHEN source_id IN (SELECT id FROM holders) THEN 'strict:containment' WHEN mag < 25.5 AND {sfin('fill')} AND fill >= 0 AND fill < 0.1 THEN 'strict:low_fill' WHEN snr < 7 THEN 'strict:snr_strict' ELSE 'clean:' END AS final FROM started)"""


@query("label_ordinary_cosmos", with_tables("sources", _COSMOS_ROWS, _RICH_SQL, *_TOUCHING, _RIM, _COSMOS, removal("holders", "nested")))
def label_ordinary_cosmos(spark, sf):
    return ordinary.label_ordinary_cosmos(full(spark, sf), ["band"])


@query("label_ordinary_a2744")
def label_ordinary_a2744(spark, sf):
    """Stars are every 97th source, three times as large, as pixels; aperture ratios are those of the aperture's flux."""
    s = full(spark, sf)
    stars = s.filter("source_id % 97 = 0").selectExpr("struct(band, source_id) AS id", "x AS cx", "y AS cy", "a * 3 AS a", "b * 3 AS b", "theta")
    frame = (1 << 30, 1024)
    mask = P.rasterize_ellipse(stars, *frame).select("id.band", "x", "y")
    measured = s.select("source_id", (C("ap_flux") / C("flux_err")).alias("snr"), (C("source_id") % 3 > 0).alias("trusted"))
    return ordinary.label_ordinary_a2744(s, ["band"], star_mask=mask, frame=frame, measured=measured)


_CLUSTERS = f"""touches AS MATERIALIZED (SELECT i.a, i.b, i.iou, n.d FROM pixel_ious i JOIN near n ON n.a = i.a AND n.b = i.b WHERE i.iou > 0),
links AS MATERIALIZED (SELECT a, b FROM touches WHERE iou >= 0.05 AND d <= 50 UNION SELECT b, a FROM touches WHERE iou >= 0.05 AND d <= 50), {_REACH},
grouped AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY cluster) AS members FROM (SELECT s.band, s.source_id, s.x, s.y, s.area, least(s.source_id, coalesce(r.first, s.source_id)) AS cluster FROM sources s LEFT JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) r ON r.a = s.source_id)),
marked AS MATERIALIZED (SELECT *, members = 1 AND source_id NOT IN (SELECT a FROM touches UNION SELECT b FROM touches) AS isolated FROM grouped),
crowded AS (SELECT band, cluster, x, y FROM marked WHERE NOT isolated), centers AS (SELECT band, cluster, avg(x) AS x, avg(y) AS y FROM crowded GROUP BY ALL), stars AS (SELECT * FROM detections WHERE det_id % 7 = 0),
{pairs_sql('stars', 'det_id', 'crowded', 'cluster', 6.0, 'by_member')}, {pairs_sql('stars', 'det_id', 'centers', 'cluster', 10.0, 'by_center')},
met AS MATERIALIZED (SELECT band, a AS star_id, b AS cluster FROM by_member UNION SELECT band, a, b FROM by_center)"""


@query("bright_clusters", with_tables("sources detections", """SELECT band, source_id, cluster, members, CASE WHEN isolated AND area < 500 THEN 'clean' WHEN isolated THEN 'center_only' WHEN cluster IN (SELECT cluster FROM met) THEN 'restricted' ELSE 'ignore' END AS label FROM marked
UNION ALL SELECT m.band, -m.star_id - 1, m.cluster, c.members, 'strict' FROM met m JOIN (SELECT DISTINCT cluster, members FROM marked) c USING (cluster)""", *_TOUCHING, _PIXEL_IOU.replace(" AND s.area < 1200 AND t.area < 1200", ""), _CLUSTERS))
def bright_clusters(spark, sf):
    stars = detections(spark, sf).filter("det_id % 7 = 0").withColumnRenamed("det_id", "star_id")
    return jobs.bright_clusters(full(spark, sf), stars, ["band"])


@query("photometry_eval", with_tables("sources detections", BY_BIN.replace("mutual n", "taken n"), NEAR, matching("taken", "near"), BINS))
def photometry_eval(spark, sf):
    targets = sources(spark, sf).withColumns({"mag": E.flux_to_mag("kron_flux"), "keep": C("area") > 300})
    predictions = detections(spark, sf).withColumn("mag", E.flux_to_mag("ap_flux"))
    found = jobs.photometry_eval(targets, predictions, 3.0, "band", 20.0, 30.0, 0.5)
    return found.withColumns({"completeness": out("completeness"), "purity": out("purity")})


_SPLIT = """places AS MATERIALIZED (SELECT source, patch, row_number() OVER (ORDER BY md5('3:' || source || ':' || patch), source, patch) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source, patch FROM samples)),
held AS MATERIALIZED (SELECT source, patch FROM places WHERE k <= greatest(1, round_even(n * 0.05, 0))),
seen AS MATERIALIZED (SELECT * FROM samples JOIN held USING (source, patch)),
free AS MATERIALIZED (SELECT * FROM samples t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source = t.source AND h.patch = t.patch) AND NOT EXISTS (SELECT 1 FROM seen v WHERE v.source = t.source AND abs(v.bx - t.bx) < 32 AND abs(v.by - t.by) < 32)),
ranked AS (SELECT source, patch, -ln((('0x' || substr(md5('3:' || source || ':' || patch), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (0.2::DOUBLE + 0.8::DOUBLE * pow(CASE WHEN top > 0 THEN f / top ELSE 0 END, 2)) AS w FROM (SELECT *, max(f) OVER (PARTITION BY source) AS top FROM (SELECT source, patch, sum(CASE WHEN band = 'SMALL' THEN num_samples ELSE 0 END)::DOUBLE / sum(num_samples) AS f FROM free GROUP BY ALL)))"""


@query("split_builder", with_tables("samples", "SELECT source, patch, 'train' AS part FROM (SELECT source, patch, row_number() OVER (ORDER BY w, source, patch) AS n FROM ranked) WHERE n <= 40 UNION ALL SELECT source, patch, 'validation' FROM held", _SPLIT))
def split_builder(spark, sf):
    return jobs.split_builder(samples(spark, sf), ["SMALL"], 0.05, 40, 3)


@query("variant_visibility", with_tables("sources weights", f"""SELECT source_id, CASE WHEN s > 7 THEN 'clean' WHEN s > 5 THEN 'weak_shape' ELSE 'ignore' END AS class, {sout('s')} AS snr FROM (
SELECT source_id, CASE WHEN {sfin('flux')} AND flux > 0 AND part > 0 THEN flux / flux_err * sqrt(least(part / whole, 1.0::DOUBLE)) ELSE 'NaN'::DOUBLE END AS s0, CASE WHEN isnan(s0) THEN -1 ELSE s0 END AS s FROM sources
JOIN (SELECT grp, sum(weight) FILTER (WHERE valid) AS part, sum(weight) AS whole FROM weights WHERE {sfin('weight')} AND weight > 0 GROUP BY grp) w ON w.grp = source_id % 7 + 1)""").replace(sout("s"), "CASE WHEN s >= 0 THEN round(s, 6) END"))
def variant_visibility(spark, sf):
    w = weights(spark, sf)
    whole = A.weight_summary(w, ["grp"]).select("grp", C("total").alias("whole"))
    part = A.weight_summary(w.filter("valid"), ["grp"]).select("grp", C("total").alias("part"))
    s = sources(spark, sf).withColumn("grp", (C("source_id") % 7 + 1).cast("int")).join(whole.join(part, "grp"), "grp")
    one = F.lit(1.0)
    snr, _ = E.snr_from_weight_ratio(E.snr(C("flux"), C("flux_err")), C("whole"), C("part"), one, one)
    s = s.withColumn("s", snr)
    return s.select("source_id", R.snr_class(C("s"), F.lit(False)).alias("class"), out("s").alias("snr"))


_AGAIN = f"""again AS MATERIALIZED (SELECT *, diff * 0.7::DOUBLE AS fresh, n_child = 0 AND source_id % 3 > 0 AND source_id % 41 <> 0 AND {sfin('diff')} AND abs(diff) > 1 AS chosen FROM rich),
judged AS MATERIALIZED (SELECT *, list_sort(list_filter([CASE WHEN {sfin('fresh')} AND abs(fresh) <= 1.5 AND {sfin('fill')} AND fill < 0.2 THEN 'small_footprint_large_aperture' END, CASE WHEN area > 10000 THEN 'area_gt_max' END, CASE WHEN {sfin('mag')} AND mag > 28 AND area > 900 THEN 'faint_and_large' END, CASE WHEN ratio > 5 THEN 'axis_ratio' END, CASE WHEN NOT {sfin('fresh')} THEN 'invalid_new_diff' WHEN abs(fresh) > 1.5 THEN 'new_diff' END], lambda r: r IS NOT NULL)) AS why FROM again),
pool AS MATERIALIZED (SELECT source_id FROM judged WHERE (chosen AND len(why) = 0) OR source_id % 3 = 0),
holders AS MATERIALIZED (SELECT CASE WHEN a_area < b_area THEN b ELSE a END AS id FROM ious WHERE a IN (SELECT source_id FROM pool) AND b IN (SELECT source_id FROM pool) AND ((a_area < b_area AND in_b >= 0.8) OR (b_area < a_area AND in_a >= 0.8)))"""


@query("remeasure_rescue", with_tables("sources", """SELECT source_id, CASE WHEN list_contains(w, 'area_gt_max') THEN 'drop' WHEN len(w) > 0 THEN 'ignore' WHEN abs(fresh) < 1 THEN 'clean' ELSE 'center_only' END AS class, array_to_string(w, ';') AS reason
FROM (SELECT *, CASE WHEN len(why) = 0 AND source_id IN (SELECT id FROM holders) THEN ['contains_smaller'] ELSE why END AS w FROM judged WHERE chosen)""", _RICH_SQL, *_TOUCHING, _GRID, _OVER, _AGAIN))
def remeasure_rescue(spark, sf):
    s = rich(spark, sf).withColumns({"old_diff": C("diff"), "new_diff": C("diff") * 0.7, "ignored": C("source_id") % 3 > 0, "clean": C("source_id") % 3 == 0, "skip": C("source_id") % 41 == 0})
    return jobs.remeasure_rescue(s, ["band"])


def _planes(spark, sf):
    """The pixels' places and masks, made once for all that a query takes from them."""
    return stash(pixels(spark, sf).select("band", "x", "y", "mask", "cell"), "planes")


def _runs(spark, sf, planes=None):
    planes = pixels(spark, sf) if planes is None else planes
    return stash(P.regions(planes.filter(E.mask_bit(C("mask"), 0)), ["band"]), "runs")


def _points(spark, sf, bit, planes=None):
    planes = pixels(spark, sf) if planes is None else planes
    return planes.filter(E.mask_bit(C("mask"), bit)).selectExpr("band", "x AS px", "y AS py", "cell AS id")


@query("footprint_span_join", with_tables("pixels", "SELECT c.band, c.cell AS id, p.x, p.y, round(p.image) AS image FROM pixels c JOIN pixels p ON p.band = c.band AND p.y = c.y AND p.x BETWEEN c.x - 2 AND c.x + 1 WHERE (c.mask & 4) <> 0"))
def footprint_span_join(spark, sf):
    spans = pixels(spark, sf).filter(E.mask_bit(C("mask"), 2)).selectExpr("band", "cell AS id", "y", "x - 2 AS x0", "x + 1 AS x1")
    return O.footprint_span_join(spans, pixels(spark, sf), ["band"]).withColumn("image", F.round("image"))


@query("disk_offsets", with_tables("pixels", "SELECT c.cell AS id, count(*) AS n FROM pixels c JOIN pixels p ON p.band = c.band AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 12.25 WHERE (c.mask & 1) <> 0 GROUP BY c.cell"))
def disk_offsets(spark, sf):
    return P.count_around(_points(spark, sf, 0), pixels(spark, sf).select("band", "x", "y"), P.disk_offsets(3.5), ["band"]).select("id", "n")


def _measured(name: str, centers: str, planes: str = "pixels") -> str:
    """Table ``name`` (band, id, flux, snr, internal, trusted): apertures of radius 1 about ``centers`` with annuli from 2 to 4, in SQL."""
    noise = _FREE.replace("free AS", f"{name}_free AS").replace("apertures AS", f"{name}_apertures AS").replace("FROM free", f"FROM {name}_free").replace("FROM pixels", f"FROM {planes}")
    sums = f"SELECT c.band, c.id, sum(p.image) FILTER (WHERE r2 <= 1) AS s, count(*) FILTER (WHERE r2 <= 1) AS n, quantile_cont(p.image, 0.5) FILTER (WHERE r2 > 4) AS m, count(*) FILTER (WHERE r2 > 4) AS n_ann FROM (SELECT c.*, p.image, (p.x - c.px) * (p.x - c.px) + (p.y - c.py) * (p.y - c.py) AS r2 FROM {centers} c JOIN {planes} p ON p.band = c.band AND abs(p.x - c.px) <= 4 AND abs(p.y - c.py) <= 4 WHERE (p.mask & 3) <> 3) c WHERE r2 <= 16 GROUP BY c.band, c.id".replace("p.image)", "c.image)").replace("quantile_cont(p.image", "quantile_cont(c.image")
    return f"""{noise}, {_clipped(f'{name}_noise', f'{name}_apertures', 'band', 'total', True, False)},
{name}_sums AS ({sums}), {name}_sized AS (SELECT band, count(*) AS whole FROM {name}_apertures GROUP BY band),
{name} AS MATERIALIZED (SELECT band, id, flux, snr, internal, whole >= 16 AND sd > 0 AND internal AND n_ann >= 1 AND {sfin('snr')} AS trusted FROM (SELECT *, CASE WHEN sigma > 0 THEN flux / sigma ELSE 'NaN'::DOUBLE END AS snr FROM (SELECT q.band, q.id, q.s - coalesce(q.m, 0) * q.n AS flux, o.sd * sqrt(q.n / 5.0::DOUBLE) AS sigma, q.n = 5 AS internal, q.n_ann, o.sd, z.whole FROM {name}_sums q JOIN {name}_noise o ON o.band = q.band JOIN {name}_sized z ON z.band = q.band WHERE q.n > 0)))"""


@query("ap2_snr_measure", with_tables("pixels", f"SELECT band, id, round(flux) AS flux, {sout('snr', 4)} AS snr, internal, trusted FROM ap", _measured("ap", "(SELECT band, cell AS id, x AS px, y AS py FROM pixels WHERE (mask & 4) <> 0)")))
def ap2_snr_measure(spark, sf):
    p = pixels(spark, sf).withColumn("excluded", E.mask_bit(C("mask"), 0) & E.mask_bit(C("mask"), 1))
    found = O.ap2_snr_measure(_points(spark, sf, 2), p, 1.0, 2.0, 4.0, ["band"])
    return found.select("band", "id", F.round("flux").alias("flux"), out("snr", 4).alias("snr"), "internal", "trusted")


_SEEN = """common AS MATERIALIZED (SELECT band, a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM (
  SELECT l.band, l.cell AS a, r.cell AS b, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM pixels l JOIN pixels r ON r.band = l.band AND abs(r.x - l.x) + abs(r.y - l.y) <= 1 WHERE (l.mask & 2) <> 0 AND (r.mask & 4) <> 0)) WHERE ra = 1 AND rb = 1),
alone AS MATERIALIZED (SELECT band, 'only_a' AS kind, cell, 'a' || cell AS id, x AS px, y AS py FROM pixels WHERE (mask & 2) <> 0 AND cell NOT IN (SELECT a FROM common)
  UNION ALL SELECT band, 'only_b', cell, 'b' || cell, x, y FROM pixels WHERE (mask & 4) <> 0 AND cell NOT IN (SELECT b FROM common)),
later AS MATERIALIZED (SELECT * REPLACE (image + n * 100.0::DOUBLE AS image) FROM pixels)"""
_VISITS = f"SELECT band, a, b, 'common' AS kind, NULL::DOUBLE AS snr_a, NULL::BOOLEAN AS trusted_a, NULL::DOUBLE AS snr_b, NULL::BOOLEAN AS trusted_b FROM common UNION ALL SELECT o.band, CASE WHEN kind = 'only_a' THEN cell END, CASE WHEN kind = 'only_b' THEN cell END, kind, {sout('pa.snr', 4)}, pa.trusted, {sout('pb.snr', 4)}, pb.trusted FROM alone o LEFT JOIN pa USING (band, id) LEFT JOIN pb USING (band, id)"


@query("visit_difference", with_tables("pixels", _VISITS, _SEEN, _measured("pa", "alone"), _measured("pb", "alone", "later")))
def visit_difference(spark, sf):
    """Two visits of the pixel planes: detections are the cells of two mask bits, measured on either."""
    p = pixels(spark, sf)
    seen = lambda bit: p.filter(E.mask_bit(C("mask"), bit)).selectExpr("band", "cell AS id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y")
    plane = lambda value: p.select("band", "x", "y", value.alias("image"), (E.mask_bit(C("mask"), 0) & E.mask_bit(C("mask"), 1)).alias("excluded"))
    found = W.visit_difference(seen(1), seen(2), 1.0, ["band"], "id", (plane(C("image")), plane(C("image") + C("n") * 100.0)), (1.0, 2.0, 4.0))
    return found.select("band", "a", "b", "kind", out("snr_a", 4).alias("snr_a"), "trusted_a", out("snr_b", 4).alias("snr_b"), "trusted_b")


_LINKS = """members AS (SELECT l.object, l.band, CASE WHEN l.id % 4 > 0 THEN s.user_id % 50 END AS target FROM linked l JOIN sources s ON s.source_id = l.id),
want AS (SELECT user_id % 50 AS target, list_sort(list(DISTINCT band)) AS want FROM sources GROUP BY ALL),
sets AS (SELECT object, list_sort(list(DISTINCT band)) AS bands, count(DISTINCT target) AS ids, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(*) FILTER (WHERE target IS NULL) AS loose FROM members GROUP BY object),
whole AS (SELECT s.*, coalesce(loose = 0 AND want = bands, false) AS ok FROM sets s LEFT JOIN want USING (target)),
kinds AS (SELECT CASE WHEN ok AND n = 1 THEN 'tp' WHEN ok THEN 'fp' WHEN ids > 0 THEN 'partial' ELSE 'fp' END AS kind, array_to_string(bands, '') AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY target, ok ORDER BY object) AS n FROM whole)
  UNION ALL SELECT 'fn', array_to_string(want, '') FROM want WHERE target NOT IN (SELECT target FROM whole WHERE ok))"""


@query("link_metrics", with_tables("sources", "SELECT kind, pattern, count(*) AS n FROM kinds GROUP BY ALL", linked_sql(6.0), _LINKS))
def link_metrics(spark, sf):
    s, bands = sources(spark, sf), ["click", "error", "purchase", "signup", "view"]
    linked = J.band_link(s.selectExpr("source_id AS id", "band", "x", "y", "1 AS one"), bands, 6.0, ["one"])
    members = linked.join(s.select(C("source_id").alias("id"), C("band"), (C("user_id") % 50).alias("source_id")), "id").select("object", "band", F.when(C("id") % 4 > 0, C("source_id")).alias("source_id"))
    return O.link_metrics(members, s.select((C("user_id") % 50).alias("source_id"), "band"))


#: Regions of the first mask bit, named by their least cell of a run, with the region of every pixel.
_REGIONS = f"""runs AS MATERIALIZED (SELECT band, y, min(x) AS x0, max(x) AS x1, count(*) AS n, min(cell) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY band, y ORDER BY x) AS k FROM pixels WHERE (mask & 1) <> 0) GROUP BY band, y, k),
links AS MATERIALIZED (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.band = b.band AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1), {_REACH},
regions AS MATERIALIZED (SELECT r.*, least(r.run, coalesce(l.first, r.run)) AS region FROM runs r LEFT JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) l ON l.a = r.run),
lit AS MATERIALIZED (SELECT r.band, r.region, p.x, p.y, p.mask FROM regions r JOIN pixels p ON p.band = r.band AND p.y = r.y AND p.x BETWEEN r.x0 AND r.x1)"""


@query("seeded_component_centers", with_tables("pixels", "SELECT band, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS area FROM lit GROUP BY band, region HAVING count(*) >= 3 AND NOT bool_or(x = 0 OR x = 63 OR y = 0 OR y = 63) AND bool_or((mask & 2) <> 0) AND NOT bool_or(mask = 7)", _REGIONS))
def seeded_component_centers(spark, sf):
    """Regions of the first mask bit, with seeds where the second is on and positives where all are."""
    planes = _planes(spark, sf)
    positives = _points(spark, sf, 0, planes.filter("mask = 7"))
    found = O.seeded_component_centers(_runs(spark, sf, planes), _points(spark, sf, 1, planes), positives, ["band"], 64, 64, 3)
    return found.select("band", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "area")


_NESTED = """centers AS MATERIALIZED (SELECT band, region, avg(x) AS cx, avg(y) AS cy, min(y * 64 + x) AS first, count(*) AS n FROM lit GROUP BY band, region),
parents AS MATERIALIZED (SELECT band, cell AS id, x, y, (cell % 4 + 3)::DOUBLE AS a, (cell % 3 + 2)::DOUBLE AS b FROM pixels WHERE (mask & 4) <> 0),
inside AS (SELECT l.region, p.id, p.a * p.b AS area, count(*) AS n FROM lit l JOIN parents p ON p.band = l.band AND pow((l.x - p.x) / p.a, 2) + pow((l.y - p.y) / p.b, 2) <= 1 GROUP BY ALL),
nested AS MATERIALIZED (SELECT c.band, c.region, c.cx AS x, c.cy AS y, h.id AS parent, row_number() OVER (ORDER BY h.area, c.first, c.region) AS k FROM centers c JOIN (SELECT *, row_number() OVER (PARTITION BY region ORDER BY area, id) AS r FROM inside JOIN centers USING (region, n)) h ON h.region = c.region AND h.r = 1
  WHERE NOT EXISTS (SELECT 1 FROM pixels p WHERE p.band = c.band AND p.mask = 7 AND abs(p.x - c.cx) <= 1 AND abs(p.y - c.cy) <= 1 AND sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy)) <= 1)),
together AS MATERIALIZED (SELECT l.k AS later, e.k AS earlier FROM nested l JOIN nested e ON e.band = l.band AND e.k < l.k AND sqrt((l.x - e.x) * (l.x - e.x) + (l.y - e.y) * (l.y - e.y)) <= 1)"""


@query("nested_component_centers", with_tables("pixels", "SELECT band, parent, round(x, 6) AS cx, round(y, 6) AS cy FROM nested WHERE k NOT IN (SELECT k FROM turn WHERE s = 2)", _REGIONS, _NESTED, decided("turn", "together")))
def nested_component_centers(spark, sf):
    planes = _planes(spark, sf)
    parents = _points(spark, sf, 2, planes).selectExpr("band", "id", "CAST(px AS DOUBLE) AS x", "CAST(py AS DOUBLE) AS y", "CAST(id % 4 + 3 AS DOUBLE) AS a", "CAST(id % 3 + 2 AS DOUBLE) AS b", "0D AS theta", "CAST((id % 4 + 3) * (id % 3 + 2) AS DOUBLE) AS area")
    centers = planes.filter("mask = 7").selectExpr("band", "cell AS id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y")
    found = O.nested_component_centers(_runs(spark, sf, planes), parents, centers, 1.0, ["band"])
    return found.select("band", "parent", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


#: Sources reach one pixel, and three in a row where their axis is 1; the pixels of a pair tell their overlap.
_BRIGHT = """extents AS MATERIALIZED (SELECT band, region, count(*) AS pixels, avg(x) AS cx, avg(y) AS cy, bool_or(x = 0 OR x = 63 OR y = 0 OR y = 63) AS edge FROM lit GROUP BY band, region),
own AS MATERIALIZED (SELECT p.band, p.cell AS id, p.x, p.y, (p.cell % 4 + 1) / 4.0::DOUBLE AS a, (p.cell % 3 + 1) / 4.0::DOUBLE AS b, (p.cell % 90)::DOUBLE AS area, (p.cell % 10) / 9.0::DOUBLE > 0.5 AS blended, p.cell % 5 = 0 AS star, l.region, coalesce(l.region, -1) AS place, e.pixels, p.cell % 90 >= 85 AS dropped
  FROM pixels p LEFT JOIN lit l ON l.band = p.band AND l.x = p.x AND l.y = p.y LEFT JOIN extents e ON e.band = l.band AND e.region = l.region WHERE (p.mask & 4) <> 0),
pending AS MATERIALIZED (SELECT * FROM own WHERE NOT dropped),
painted AS MATERIALIZED (SELECT band, place, id, x + dx AS gx, y AS gy, CASE WHEN a >= 1 THEN 3 ELSE 1 END AS n FROM pending JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON dx = 0 OR a >= 1),
touching AS MATERIALIZED (SELECT s.id AS a, t.id AS b, count(*)::DOUBLE / (any_value(s.n) + any_value(t.n) - count(*)) AS iou FROM painted s JOIN painted t ON t.band = s.band AND t.place = s.place AND t.gx = s.gx AND t.gy = s.gy AND t.id > s.id GROUP BY s.id, t.id),
pair_links AS MATERIALIZED (SELECT a, b FROM touching WHERE iou >= 1.0::DOUBLE / 3.0::DOUBLE UNION SELECT b, a FROM touching WHERE iou >= 1.0::DOUBLE / 3.0::DOUBLE),
pair_reach(a, b) AS (SELECT a, b FROM pair_links UNION SELECT r.a, l.b FROM pair_reach r JOIN pair_links l ON l.a = r.b),
crowds AS (SELECT band, region, min(id) AS head FROM pending WHERE region IS NOT NULL GROUP BY band, region HAVING count(*) >= 256),
clustered AS MATERIALIZED (SELECT p.*, coalesce(h.head, least(p.id, coalesce(r.first, p.id))) AS cluster FROM pending p LEFT JOIN crowds h ON h.band = p.band AND h.region = p.region LEFT JOIN (SELECT a, min(b) AS first FROM pair_reach GROUP BY a) r ON r.a = p.id),
grouped AS MATERIALIZED (SELECT c.*, count(*) OVER (PARTITION BY cluster) AS members, g.clusters, id IN (SELECT a FROM touching UNION SELECT b FROM touching) AS touched FROM clustered c JOIN (SELECT band, place, count(DISTINCT cluster) AS clusters FROM clustered GROUP BY band, place) g USING (band, place)),
stated AS MATERIALIZED (SELECT band, id, region, cluster, CASE WHEN alone AND blended THEN 'ignore:high_blendedness' WHEN alone AND usable AND small AND NOT (region IS NOT NULL AND clusters > 1) THEN 'clean:isolated_small' WHEN alone AND usable AND NOT star THEN 'weak:isolated_large' WHEN alone AND usable THEN 'center_only:isolated_star' ELSE 'ignore:cluster_without_star' END AS state
  FROM (SELECT *, members = 1 AND NOT touched AS alone, greatest(a, b) <= 5 * least(a, b) AS usable, greatest(coalesce(pixels, 0), area) < 40 AS small FROM grouped)),
bright_stars AS MATERIALIZED (SELECT p.band, p.cell AS star_id, p.x, p.y, l.region FROM pixels p LEFT JOIN lit l ON l.band = p.band AND l.x = p.x AND l.y = p.y WHERE (p.mask & 2) <> 0 AND p.cell % 3 = 0 AND p.cell % 30 < 22),
middles AS (SELECT band, cluster, avg(x) AS x, avg(y) AS y FROM grouped GROUP BY band, cluster),
offers AS (SELECT band, star_id, cluster, k, d FROM (SELECT s.band, star_id, cluster, 0 AS k, 0.5 AS far, sqrt((s.x - g.x) * (s.x - g.x) + (s.y - g.y) * (s.y - g.y)) AS d FROM bright_stars s JOIN grouped g ON g.band = s.band AND s.region IS NULL AND g.x = s.x AND g.y = s.y
  UNION ALL SELECT s.band, star_id, cluster, 1, 1.0, sqrt((s.x - g.x) * (s.x - g.x) + (s.y - g.y) * (s.y - g.y)) FROM bright_stars s JOIN middles g ON g.band = s.band AND s.region IS NULL AND abs(s.x - g.x) <= 1 AND abs(s.y - g.y) <= 1) WHERE d <= far),
best_offers AS (SELECT band, star_id, cluster, min_by(d, k * 10 + d) AS d FROM offers GROUP BY band, star_id, cluster),
met AS MATERIALIZED (SELECT b.band, b.star_id, b.cluster, h.region FROM (SELECT *, row_number() OVER (PARTITION BY band, star_id ORDER BY d, cluster) AS n FROM best_offers) b JOIN (SELECT cluster, any_value(region) AS region FROM grouped GROUP BY cluster) h USING (cluster) WHERE n = 1),
starred AS MATERIALIZED (SELECT band, star_id, region FROM bright_stars WHERE region IS NOT NULL UNION SELECT band, star_id, region FROM met WHERE region IS NOT NULL),
labels AS MATERIALIZED (SELECT band, id, region, CASE WHEN region IN (SELECT region FROM starred) OR cluster IN (SELECT cluster FROM met WHERE region IS NULL) THEN 'restricted:fragment_of_star' ELSE state END AS state FROM (SELECT * FROM stated UNION ALL SELECT band, id, region, NULL, 'ignore:large_area' FROM own WHERE dropped)),
added AS MATERIALIZED (SELECT band, -star_id - 1 AS id, region FROM starred UNION SELECT band, -star_id - 1, NULL FROM met WHERE region IS NULL),
taken AS (SELECT region FROM labels WHERE region IS NOT NULL AND state NOT LIKE 'ignore:%' UNION SELECT region FROM added WHERE region IS NOT NULL),
kinds AS (SELECT region, bool_or(blended) AS blended, bool_and(NOT star) AS no_star FROM own WHERE region IS NOT NULL GROUP BY region)"""
_BRIGHT_ROWS = """SELECT band, id, split_part(state, ':', 1) AS label, split_part(state, ':', 2) AS reason, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy FROM labels UNION ALL SELECT band, id, 'strict', 'reliable_star', NULL, NULL FROM added
UNION ALL SELECT e.band, NULL, 'strict', 'empty_component_center', round(cx, 6), round(cy, 6) FROM extents e LEFT JOIN kinds k USING (region) WHERE region NOT IN (SELECT region FROM taken) AND pixels > 2 AND NOT edge AND NOT coalesce(blended, false) AND NOT coalesce(no_star, false)"""


@query("component_bright_labels", with_tables("pixels", _BRIGHT_ROWS, _REGIONS, _BRIGHT))
def component_bright_labels(spark, sf):
    cells = lambda bit: _points(spark, sf, bit).selectExpr("band", "id", "CAST(px AS DOUBLE) AS x", "CAST(py AS DOUBLE) AS y")
    s = cells(2).selectExpr("band", "id AS source_id", "x", "y", "CAST(id % 4 + 1 AS DOUBLE) / 4D AS a", "CAST(id % 3 + 1 AS DOUBLE) / 4D AS b", "0D AS theta", "CAST(id % 90 AS DOUBLE) AS area", "CAST(id % 10 AS DOUBLE) / 9D AS blendedness", "id % 5 = 0 AS star")
    stars = cells(1).selectExpr("band", "id AS star_id", "x", "y", "CAST(id % 30 AS DOUBLE) AS mag", "id % 3 = 0 AS reliable")
    policy = O.BrightPolicy(drop_area=85.0, isolated_area=40.0, empty_area=2.0, source_match=0.5, centroid_match=1.0)
    found = O.component_bright_labels(s, _runs(spark, sf), stars, ["band"], 64, 64, policy)
    return found.select("band", "id", "label", "reason", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("kron_refit", with_tables("pixels refit", f"SELECT k.id, round(k.radius, 6) AS radius, round(k.radius / r.radius, 6) AS ratio FROM kron k JOIN refit r ON r.source_id = k.id WHERE r.good AND r.radius > 0 AND k.radius IS NOT NULL", "centers AS (SELECT cell AS id, band, x AS px, y AS py FROM pixels WHERE (mask & 2) <> 0)", kron_sql("centers", (4, 2), 1.5, 1.0, 6.0)))
def kron_refit(spark, sf):
    from lumenfold.plans.tables import refit

    chosen = refit(spark, sf).filter("good AND radius > 0").select(C("source_id").alias("id"), C("radius").alias("official"))
    c = _points(spark, sf, 1)
    spans = c.withColumn("y", F.explode(F.sequence(C("py") - 2, C("py") + 2))).selectExpr("band", "id", "y", "px - 4 AS x0", "px + 4 AS x1")
    shape = c.selectExpr("id", "CAST(px AS DOUBLE) AS cx", "CAST(py AS DOUBLE) AS cy", "1.5D AS a", "1D AS b", "0D AS theta")
    m = P.kron_moment(spans, pixels(spark, sf), shape, ["band"]).join(chosen, "id").filter(E.finite("radius"))
    return m.select("id", out("radius").alias("radius"), out(C("radius") / C("official")).alias("ratio"))
