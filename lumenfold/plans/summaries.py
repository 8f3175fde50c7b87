"""Queries of the aggregates, generators, selections, set operations and pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import joins as J
from lumenfold.operators import pixels as P
from lumenfold.operators import rules as R
from lumenfold.operators import summaries as A
from lumenfold.plans.joins import _MUTUAL, NEAR, RADIUS, det_pairs
from lumenfold.plans.registry import query
from lumenfold.plans.rules import _RICH_SQL, r, rich
from lumenfold.plans.tables import detections, out, pixels, read, samples, sfin, smag, sources, sout, weights, with_tables
from lumenfold.session import stash

S, SD = "sources", "sources detections"
C = F.col


def rd(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def srd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


LOW, HIGH, WIDTH = 20.0, 30.0, 0.5
BINS = f"bins AS (SELECT i AS bin, {LOW}::DOUBLE + i * {WIDTH}::DOUBLE AS lo, {LOW}::DOUBLE + (i + 1) * {WIDTH}::DOUBLE AS hi FROM (SELECT unnest(range(20)) AS i))"


@query("mag_bins", with_tables(S, f"SELECT bin, lo, hi, lo + 0.25::DOUBLE AS center, count(source_id) AS n FROM bins LEFT JOIN (SELECT source_id, {smag('kron_flux')} AS mag FROM sources) ON mag >= lo AND mag < hi GROUP BY ALL", BINS))
def mag_bins(spark, sf):
    s = sources(spark, sf).withColumn("mag", E.flux_to_mag("kron_flux"))
    counted = A.binned(s, "mag", LOW, HIGH, WIDTH).groupBy("bin").agg(F.count("*").alias("n"))
    return A.mag_bins(spark, LOW, HIGH, WIDTH).join(F.broadcast(counted), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_MAG = smag("kron_flux")


@query("completeness_by_bin", with_tables(SD, f"SELECT g.band, g.bin, g.lo, g.hi, count(m.source_id) AS total, count(m.det) AS matched, CASE WHEN count(m.source_id) > 0 THEN round(count(m.det)::DOUBLE / count(m.source_id), 6) END AS completeness FROM (SELECT * FROM (SELECT DISTINCT band FROM sources), bins) g LEFT JOIN (SELECT s.source_id, s.band, {_MAG} AS mag, n.b AS det FROM sources s LEFT JOIN mutual n ON n.b = s.source_id) m ON m.band = g.band AND m.mag >= g.lo AND m.mag < g.hi GROUP BY ALL", NEAR, _MUTUAL, BINS))
def completeness_by_bin(spark, sf):
    s = sources(spark, sf).withColumn("mag", E.flux_to_mag("kron_flux"))
    m = J.mutual_nearest_match(detections(spark, sf), s, RADIUS, ["band"], "det_id", "source_id").select(C("b").alias("source_id"), F.lit(True).alias("matched"))
    found = A.completeness_by_bin(s.join(m, "source_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False))), "band", LOW, HIGH, WIDTH)
    return found.withColumn("completeness", out("completeness"))


BY_BIN = f"""SELECT dataset, bin, sum(raw_total)::BIGINT AS raw_total, sum(raw_matched)::BIGINT AS raw_matched, sum(ref_total)::BIGINT AS ref_total, sum(ref_matched)::BIGINT AS ref_matched, sum(pred_total)::BIGINT AS pred_total, sum(pred_matched)::BIGINT AS pred_matched,
CASE WHEN sum(ref_total) > 0 THEN round(sum(ref_matched)::DOUBLE / sum(ref_total), 6) END AS completeness, CASE WHEN sum(pred_total) > 0 THEN round(sum(pred_matched)::DOUBLE / sum(pred_total), 6) END AS purity
FROM (SELECT unnest([band, 'all']) AS dataset, bin, raw_total, raw_matched, ref_total, ref_matched, pred_total, pred_matched FROM (
 SELECT band, bin, 1 AS raw_total, hit::INT AS raw_matched, keep::INT AS ref_total, (keep AND hit)::INT AS ref_matched, 0 AS pred_total, 0 AS pred_matched FROM (SELECT s.band, {_MAG} AS mag, s.area > 300 AS keep, n.b IS NOT NULL AS hit FROM sources s LEFT JOIN mutual n ON n.b = s.source_id) JOIN bins ON mag >= lo AND mag < hi
 UNION ALL SELECT band, bin, 0, 0, 0, 0, 1, ok::INT FROM (SELECT d.band, {smag('ap_flux')} AS mag, coalesce(k.area > 300, false) AS ok FROM detections d LEFT JOIN mutual n ON n.a = d.det_id LEFT JOIN (SELECT source_id, area FROM sources) k ON k.source_id = n.b) JOIN bins ON mag >= lo AND mag < hi)) GROUP BY dataset, bin"""


@query("completeness_purity_by_bin", with_tables(SD, BY_BIN, NEAR, _MUTUAL, BINS))
def completeness_purity_by_bin(spark, sf):
    m = J.mutual_nearest_match(detections(spark, sf), sources(spark, sf), RADIUS, ["band"], "det_id", "source_id")
    gt = sources(spark, sf).select(C("band").alias("dataset"), C("source_id").alias("key"), E.flux_to_mag("kron_flux").alias("mag"), (C("area") > 300).alias("keep"))
    phot = detections(spark, sf).join(m.select(C("a").alias("det_id"), C("b").alias("key")), "det_id", "left").select(C("band").alias("dataset"), "key", E.flux_to_mag("ap_flux").alias("mag"))
    return A.completeness_purity_by_bin(gt, phot, LOW, HIGH, WIDTH).withColumns({"completeness": out("completeness"), "purity": out("purity")})


@query("match_summary", with_tables(SD, "SELECT band, pred, gt, tp, pred - tp AS fp, gt - tp AS fn, round(tp / pred, 6) AS precision, round(tp / gt, 6) AS recall, round(2.0 * (tp / pred) * (tp / gt) / (tp / pred + tp / gt), 6) AS f1 FROM (SELECT band, (SELECT count(*) FROM detections d WHERE d.band = b.band) AS pred, (SELECT count(*) FROM sources s WHERE s.band = b.band) AS gt, (SELECT count(*) FROM mutual m WHERE m.band = b.band) AS tp FROM (SELECT DISTINCT band FROM sources) b)", NEAR, _MUTUAL))
def match_summary(spark, sf):
    d, s = detections(spark, sf), sources(spark, sf)
    m = J.mutual_nearest_match(d, s, RADIUS, ["band"], "det_id", "source_id")
    return A.match_summary(d, s, m, "band").select("band", "pred", "gt", "tp", "fp", "fn", *rd("precision", "recall", "f1"))


@query("strict_finalize", with_tables(S, "SELECT band, targets, predictions, tp, CASE WHEN targets > 0 THEN round(tp / targets, 6) END AS completeness, CASE WHEN targets > 0 THEN round(tp / predictions, 6) END AS purity, CASE WHEN targets > 0 AND tp > 0 THEN round(2.0 * (tp / targets) * (tp / predictions) / (tp / targets + tp / predictions), 6) END AS f1 FROM (SELECT band, count(*) FILTER (WHERE band <> 'view' AND c % 2 = 0) AS targets, count(*) FILTER (WHERE c % 3 = 0) AS predictions, count(*) FILTER (WHERE band <> 'view' AND c % 6 = 0) AS tp FROM sources GROUP BY band)"))
def strict_finalize(spark, sf):
    g = sources(spark, sf).groupBy("band").agg(F.count_if((C("band") != "view") & (C("c") % 2 == 0)).alias("targets"), F.count_if(C("c") % 3 == 0).alias("predictions"), F.count_if((C("band") != "view") & (C("c") % 6 == 0)).alias("tp"))
    return A.strict_finalize(g).withColumns({n: F.round(n, 6) for n in ("completeness", "purity", "f1")})


@query("count_by_class", r("SELECT band, category, count(*) AS n FROM (SELECT band, CASE WHEN area > 900 THEN 'large' WHEN fill < 0.3 THEN 'hollow' ELSE 'plain' END AS category FROM rich) GROUP BY ALL"))
def count_by_class(spark, sf):
    return A.count_by_class(rich(spark, sf).withColumn("category", F.when(C("area") > 900, "large").when(C("fill") < 0.3, "hollow").otherwise("plain")), ["band"], "category")


@query("flux_ratio_stats", with_tables(S, f"SELECT band, name, count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.16), 6) AS p16, round(quantile_cont(r, 0.84), 6) AS p84 FROM (SELECT band, 'ap_kron' AS name, ap_flux / kron_flux AS r FROM sources UNION ALL SELECT band, 'ap_psf', ap_flux / flux FROM sources WHERE {sfin('flux')} AND flux > 0) GROUP BY ALL"))
def flux_ratio_stats(spark, sf):
    return A.flux_ratio_stats(sources(spark, sf), {"ap_kron": ("ap_flux", "kron_flux"), "ap_psf": ("ap_flux", "flux")}, "band", ("ap_psf",)).select("band", "name", "n", *rd("mean", "median", "p16", "p84"))


@query("per_tile_summary", with_tables(S, "SELECT user_id, count(*) AS detections, count(*) FILTER (WHERE f_edge) AS kept, quantile_cont(area, 0.5) AS median_area, count(DISTINCT band) AS bands FROM sources GROUP BY user_id"))
def per_tile_summary(spark, sf):
    return A.per_tile_summary(sources(spark, sf), "user_id", C("f_edge"), "area", "band")


_FLAGS = ["f_edge", "f_sat", "f_bad"]
_LONG = "flags AS (SELECT f_bright AS removed, unnest(['f_edge', 'f_sat', 'f_bad']) AS flag, unnest([f_edge, f_sat, f_bad]) AS is_set FROM sources)"


def flagged(spark, sf):
    return sources(spark, sf).withColumn("removed", C("f_bright"))


@query("flag_counts", with_tables(S, "SELECT flag, count(*) FILTER (WHERE is_set) AS n, round(avg(is_set::INT), 6) AS fraction FROM flags GROUP BY flag", _LONG))
def flag_counts(spark, sf):
    return A.flag_counts(flagged(spark, sf), _FLAGS).withColumn("fraction", F.round("fraction", 6))


@query("other_flag_fractions", with_tables(S, "SELECT flag, round(avg(is_set::INT), 6) AS fraction FROM flags WHERE removed GROUP BY flag HAVING avg(is_set::INT) >= 0.06", _LONG))
def other_flag_fractions(spark, sf):
    return A.other_flag_fractions(flagged(spark, sf), _FLAGS, 0.06).withColumn("fraction", F.round("fraction", 6))


@query("flag_enrichment", with_tables(S, "SELECT flag, round(avg(is_set::INT) FILTER (WHERE removed) - avg(is_set::INT) FILTER (WHERE NOT removed), 6) AS delta FROM flags GROUP BY flag", _LONG))
def flag_enrichment(spark, sf):
    return A.flag_enrichment(flagged(spark, sf), _FLAGS).withColumn("delta", F.round("delta", 6))


@query("descriptive_stats", with_tables(S, "SELECT band, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS p{q:02d}" for q in (5, 25, 50, 75, 95)) + f", max(v) AS max FROM (SELECT band, CASE WHEN {sfin('flux')} THEN flux END AS v FROM sources) GROUP BY band"))
def descriptive_stats(spark, sf):
    return A.descriptive_stats(sources(spark, sf), "flux", ["band"]).select("band", "n", *rd("mean", "std"), "min", *rd("p05", "p25", "p50", "p75", "p95"), "max")


@query("sequence_summary", "SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def sequence_summary(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return A.sequence_summary({k: e.filter(C("event_type") == k) for k in ("click", "error", "purchase", "signup", "view")}, "day")


_BANDS = ["click", "error", "purchase", "signup", "view"]
_PATTERN = " || ".join(f"CASE WHEN bool_or(band = '{b}') THEN '1' ELSE '0' END" for b in _BANDS)


@query("band_pattern_counts", with_tables(S, f"SELECT pattern, count(*) AS n, regexp_matches(pattern, '10+1') AS hole FROM (SELECT user_id, c % 40 AS k, {_PATTERN} AS pattern FROM sources GROUP BY ALL) GROUP BY pattern"))
def band_pattern_counts(spark, sf):
    return A.band_pattern_counts(sources(spark, sf), ["user_id", C("c") % 40], _BANDS)


@query("top_patterns", with_tables(S, f"SELECT pattern, n FROM (SELECT pattern, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pattern) AS k FROM (SELECT user_id, c % 40 AS k, {_PATTERN} AS pattern FROM sources GROUP BY ALL) GROUP BY pattern) WHERE k <= 5"))
def top_patterns(spark, sf):
    return A.top_patterns(band_pattern_counts(spark, sf), 5).select("pattern", "n")


@query("band_pair_similarity", with_tables(S, "SELECT a.band AS a_band, b.band AS b_band, count(*) AS n, round(avg(abs(a.m - b.m)), 6) AS da_mean, round(quantile_cont(abs(a.m - b.m), 0.5), 6) AS da_median, round(quantile_cont(abs(a.m - b.m), 0.1), 6) AS da_p10, round(quantile_cont(abs(a.m - b.m), 0.9), 6) AS da_p90 FROM shapes a JOIN shapes b USING (user_id) WHERE a.band < b.band GROUP BY ALL", "shapes AS (SELECT user_id, band, max(area) AS m FROM sources GROUP BY ALL)"))
def band_pair_similarity(spark, sf):
    shapes = sources(spark, sf).groupBy("user_id", "band").agg(F.max("area").alias("m"))
    found = A.band_pair_similarity(shapes, "user_id", {"da": F.abs(C("a_m") - C("b_m"))})
    return found.select("a_band", "b_band", "n", *rd("da_mean", "da_median", "da_p10", "da_p90"))


@query("class_transition", r(f"SELECT before, after, count(*) AS n FROM (SELECT CASE WHEN area > 900 THEN 'large' ELSE 'small' END AS before, CASE WHEN {sfin('snr')} AND snr > 7 THEN 'clean' WHEN {sfin('snr')} AND snr > 5 THEN 'weak_shape' ELSE 'ignore' END AS after FROM rich) GROUP BY ALL"))
def class_transition(spark, sf):
    return A.class_transition(rich(spark, sf), F.when(C("area") > 900, "large").otherwise("small"), R.snr_class(C("snr"), F.lit(False)))


@query("depth_summary", r(f"SELECT band, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, count(*) FILTER (WHERE v > 7) AS clean FROM (SELECT band, CASE WHEN {sfin('snr')} THEN snr END AS v FROM rich) GROUP BY band"))
def depth_summary(spark, sf):
    return A.depth_summary(rich(spark, sf), "snr", "band").select("band", *rd("median", "p10", "p90"), "clean")


@query("scale_estimate", with_tables(S, f"SELECT round(quantile_cont(ap_flux / flux, 0.5), 6) AS scale FROM (SELECT * FROM sources WHERE {sfin('flux')} AND flux > 0 AND ap_flux > 0 ORDER BY source_id LIMIT 5000)"))
def scale_estimate(spark, sf):
    return A.scale_estimate(sources(spark, sf), "ap_flux", "flux", "source_id").select(*rd("scale"))


@query("weight_summary", with_tables("weights", f"SELECT collection, grp, round(sum(weight), 4) AS total, count(*) AS n, min(weight) AS low, max(weight) AS high FROM weights WHERE {sfin('weight')} AND weight > 0 GROUP BY ALL"))
def weight_summary(spark, sf):
    return A.weight_summary(weights(spark, sf), ["collection", "grp"]).withColumn("total", F.round("total", 4))


@query("fill_layers", r("SELECT CASE WHEN fill < 0.3 THEN 'low' WHEN fill < 0.5 THEN 'middle' ELSE 'high' END AS layer, area > 500 AS large, count(*) AS n, round(quantile_cont(fill, 0.5), 6) AS median FROM rich GROUP BY ALL"))
def fill_layers(spark, sf):
    return A.fill_layers(rich(spark, sf), "fill", "area").withColumn("median", F.round("median", 6))


@query("unknown_mask_overlap", r("SELECT count(*) AS rows, count(*) FILTER (WHERE kron_flux > 50) AS bright, count(*) FILTER (WHERE kron_flux > 50 AND NOT f_bad) AS good, count(*) FILTER (WHERE kron_flux > 50 AND NOT f_bad AND extendedness IS NULL) AS unknown, count(*) FILTER (WHERE kron_flux > 50 AND NOT f_bad AND extendedness IS NULL AND (mask & 2) <> 0) AS hits FROM rich"))
def unknown_mask_overlap(spark, sf):
    return A.funnel(rich(spark, sf), {"bright": C("kron_flux") > 50, "good": ~C("f_bad"), "unknown": C("extendedness").isNull(), "hits": E.mask_bit(C("mask"), 1)})


@query("source_density", with_tables(S, "SELECT band, count(*) AS tiles, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, round(avg(n) FILTER (WHERE n >= 20), 6) AS mean_passing FROM (SELECT band, floor(x / 128) AS tx, floor(y / 128) AS ty, count(*) AS n FROM sources GROUP BY ALL) GROUP BY band"))
def source_density(spark, sf):
    return A.source_density(sources(spark, sf), "band", 128.0, 20).withColumns({n: F.round(n, 6) for n in ("mean", "mean_passing")})


PX = "pixels"


@query("plane_fractions", with_tables(PX, "SELECT band, round(avg(((mask & 1) <> 0)::INT), 6) AS bad, round(avg(((mask & 2) <> 0)::INT), 6) AS sat, round(avg(((mask & 3) <> 0)::INT), 6) AS any, 1.0::DOUBLE AS finite, 1.0::DOUBLE AS positive, " + ", ".join(f"round(quantile_cont(image, {q / 100}), 4) AS p{q}" for q in (1, 50, 99)) + " FROM pixels GROUP BY band"))
def plane_fractions(spark, sf):
    f = P.plane_fractions(pixels(spark, sf), {"bad": 0, "sat": 1}, ["band"])
    return f.select("band", *rd("bad", "sat", "any", "finite", "positive"), *rd("p1", "p50", "p99", digits=4))


@query("tile_bad_score", with_tables(PX, "SELECT band, tx::INT AS tx, ty::INT AS ty, round(sum(CASE WHEN (mask & 1) <> 0 THEN 1000000 WHEN (mask & 2) <> 0 THEN 400000 ELSE 0 END)::DOUBLE / count(*) / 1000000.0::DOUBLE, 6) AS score FROM pixels JOIN (SELECT unnest(range(8)) AS tx) ON x >= tx * 8 AND x < tx * 8 + 16 JOIN (SELECT unnest(range(8)) AS ty) ON y >= ty * 8 AND y < ty * 8 + 16 GROUP BY ALL"))
def tile_bad_score(spark, sf):
    score = E.bad_score(C("mask"), {"BAD": 0, "SAT": 1}, {"BAD": 1.0, "SAT": 0.4})
    return P.tile_bad_score(pixels(spark, sf), score, 16, 8, ["band"]).withColumn("score", F.round("score", 6))


_CENTERS = "centers AS (SELECT cell AS id, band, x AS px, y AS py FROM pixels WHERE (mask & 4) <> 0)"


def planes(spark, sf):
    """The pixels, made once for the centres among them and what is measured around those."""
    return stash(pixels(spark, sf).select("band", "x", "y", "mask", "cell", "image"), "planes")


def centers(p):
    return p.filter(E.mask_bit(C("mask"), 2)).selectExpr("cell AS id", "band", "x AS px", "y AS py")


_D2 = "((p.x - c.px) * (p.x - c.px) + (p.y - c.py) * (p.y - c.py))"


@query("mean_in_aperture", with_tables(PX, f"SELECT c.band, c.id, round(avg(p.image), 2) AS mean, count(*) AS n FROM centers c JOIN pixels p ON p.band = c.band AND {_D2} <= 9 GROUP BY ALL", _CENTERS))
def mean_in_aperture(spark, sf):
    p = planes(spark, sf)
    return P.mean_in_aperture(centers(p), p, 3.0, ["band"]).withColumn("mean", F.round("mean", 2))


@query("ellipse_aperture_sum", with_tables(PX, "SELECT band, id, round(sum(image)) AS total, count(*) AS n FROM (SELECT c.band, c.id, p.image, (0.8::DOUBLE * (p.x - c.px) + 0.6::DOUBLE * (p.y - c.py)) / 3.3::DOUBLE AS u, (-0.6::DOUBLE * (p.x - c.px) + 0.8::DOUBLE * (p.y - c.py)) / 1.7::DOUBLE AS v FROM centers c JOIN pixels p ON p.band = c.band AND abs(p.x - c.px) <= 4 AND abs(p.y - c.py) <= 4) WHERE u * u + v * v <= 1 GROUP BY ALL", _CENTERS))
def ellipse_aperture_sum(spark, sf):
    p = planes(spark, sf)
    c = centers(p).withColumns({"a": F.lit(3.3), "b": F.lit(1.7), "theta": F.atan2(F.lit(0.6), F.lit(0.8))})
    return P.ellipse_aperture_sum(c, p, 4, ["band"]).withColumn("total", F.round("total", 0))


@query("aperture_annulus_snr", with_tables(PX, f"SELECT band, id, n_ap, n_ann, CASE WHEN n_ann >= 2 AND n_ap > 0 AND sd > 0 THEN round((s - m * n_ap) / (sd * sqrt(n_ap)), 4) END AS snr FROM (SELECT c.band, c.id, sum(image) FILTER (WHERE {_D2} <= 4) AS s, count(*) FILTER (WHERE {_D2} <= 4) AS n_ap, count(*) FILTER (WHERE {_D2} > 9) AS n_ann, quantile_cont(image, 0.5) FILTER (WHERE {_D2} > 9) AS m, stddev_samp(image) FILTER (WHERE {_D2} > 9) AS sd FROM centers c JOIN pixels p ON p.band = c.band AND {_D2} <= 36 AND (mask & 1) = 0 GROUP BY ALL)", _CENTERS))
def aperture_annulus_snr(spark, sf):
    p = planes(spark, sf).withColumn("excluded", E.mask_bit(C("mask"), 0))
    return P.aperture_annulus_snr(centers(p), p, 2.0, 3.0, 6.0, ["band"]).withColumn("snr", out("snr", 4))


def _mad(source: str, keys: str, value: str) -> str:
    return f"(SELECT {keys}, any_value(med) AS med, 1.4826::DOUBLE * quantile_cont(abs({value} - med), 0.5) AS sigma FROM (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY {keys}) AS med FROM {source}) GROUP BY {keys})"


@query("robust_sigma", with_tables(PX, f"SELECT band, round(med, 4) AS med, round(sigma, 4) AS sigma FROM {_mad('pixels', 'band', 'image')}"))
def robust_sigma(spark, sf):
    return P.robust_sigma(pixels(spark, sf), "image", ["band"]).select("band", *rd("med", "sigma", digits=4))


def _clip(k: int) -> str:
    return f"k{k + 1} AS (SELECT p.* FROM k{k} p JOIN {_mad(f'k{k}', 'band', 'image')} m USING (band) WHERE sigma <= 0 OR abs(image - med) <= 1.5::DOUBLE * sigma)"


@query("sigma_clip", with_tables(PX, "SELECT band, round(quantile_cont(image, 0.5), 4) AS med, round(avg(image), 4) AS mean, round(stddev_pop(image), 4) AS sd, count(*) AS n FROM k3 GROUP BY band", "k0 AS (SELECT band, image FROM pixels)", _clip(0), _clip(1), _clip(2)))
def sigma_clip(spark, sf):
    return P.sigma_clip(pixels(spark, sf), "image", ["band"], 1.5, 3).select("band", *rd("med", "mean", "sd", digits=4), "n")


def _levels(source: str, keys: str, value: str, fall_back: bool = False) -> str:
    """Median, mean, deviation and robust sigma of each group, in SQL."""
    mad = f"1.4826::DOUBLE * quantile_cont(abs({value} - med), 0.5)"
    robust = f"CASE WHEN {mad} > 0 THEN {mad} ELSE stddev_pop({value}) END" if fall_back else mad
    return f"(SELECT {keys}, any_value(med) AS med, avg({value}) AS mean, stddev_pop({value}) AS sd, {robust} AS robust, count(*) AS n FROM (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY {keys}) AS med FROM {source}) GROUP BY {keys})"


def _clipped(name: str, source: str, keys: str, value: str, fresh: bool, fall_back: bool) -> str:
    """Two rounds of three sigmas as tables <name>1, <name>2 and <name> (the levels), in SQL."""
    keep = lambda m: f"(NOT {m}.robust > 0 OR abs(p.{value} - {m}.med) <= 3 * {m}.robust)"
    one = f"{name}1 AS (SELECT p.* FROM {source} p JOIN {_levels(source, keys, value, fall_back)} m USING ({keys}) WHERE {keep('m')})"
    second = _levels(f"{name}1", keys, value, fall_back)
    if fresh:  # of all values, by the bounds of the second round; without a sigma there, by those of the first
        two = f"{name}2 AS (SELECT p.* FROM {source} p JOIN {_levels(source, keys, value, fall_back)} o USING ({keys}) JOIN {second} m USING ({keys}) WHERE CASE WHEN m.robust > 0 THEN {keep('m')} ELSE {keep('o')} END)"
    else:
        two = f"{name}2 AS (SELECT p.* FROM {name}1 p JOIN {second} m USING ({keys}) WHERE {keep('m')})"
    return f"{one}, {two}, {name} AS {_levels(name + '2', keys, value, fall_back)}"


_BOXED = "boxed AS (SELECT *, floor(x / 16)::BIGINT AS bx, floor(y / 16)::BIGINT AS by_ FROM pixels)"
_SIGMA = "CASE WHEN sd > 0 THEN sd ELSE robust END"


@query("block_background", with_tables(PX, f"SELECT k.band, k.bx, k.by_ AS by, round(CASE WHEN ok THEN o.med ELSE g.med END, 4) AS med, round(CASE WHEN ok THEN o.sigma ELSE g.sigma END, 4) AS sigma, ok AS reliable FROM (SELECT DISTINCT band, bx, by_ FROM boxed) k LEFT JOIN (SELECT *, {_SIGMA} AS sigma, n >= 40 AND {_SIGMA} > 0 AS ok FROM own) o USING (band, bx, by_) JOIN (SELECT band, med, CASE WHEN {_SIGMA} > 0 THEN {_SIGMA} ELSE 1 END AS sigma FROM whole) g ON g.band = k.band", _BOXED, _clipped("own", "boxed", "band, bx, by_", "image", False, True), _clipped("whole", "pixels", "band", "image", False, True)))
def block_background(spark, sf):
    return P.block_background(pixels(spark, sf), 16, ["band"], least=40).select("band", "bx", "by", *rd("med", "sigma", digits=4), "reliable")


_FREE = "free AS (SELECT * FROM pixels WHERE (mask & 3) <> 3), apertures AS (SELECT band, cx, cy, sum(image) AS total FROM (SELECT band, x + dx AS cx, y + dy AS cy, image FROM free CROSS JOIN (SELECT unnest([0, 1, -1, 0, 0]) AS dx, unnest([0, 0, 0, 1, -1]) AS dy)) GROUP BY band, cx, cy HAVING count(*) = 5)"


@query("blank_aperture_noise", with_tables(PX, "SELECT band, round(med, 2) AS med, round(sd, 2) AS sd, round(robust, 2) AS robust, c.n, c.n >= 16 AND sd > 0 AS trusted FROM noise JOIN (SELECT band, count(*) AS n FROM apertures GROUP BY band) c USING (band)", _FREE, _clipped("noise", "apertures", "band", "total", True, False)))
def blank_aperture_noise(spark, sf):
    p = pixels(spark, sf).withColumn("excluded", E.mask_bit(C("mask"), 0) & E.mask_bit(C("mask"), 1))
    return P.blank_aperture_noise(p, 1.0, ["band"]).select("band", *rd("med", "sd", "robust", digits=2), "n", "trusted")


_RUNS_OF = "lit AS (SELECT * FROM pixels WHERE (mask & 5) = 5), runs AS (SELECT band, y, min(x) AS x0, max(x) AS x1, count(*) AS n, min(cell) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY band, y ORDER BY x) AS k FROM lit) GROUP BY band, y, k), links AS (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.band = b.band AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1)"


@query("component_stats", with_tables(PX, "SELECT band, min_by(x0, y * 64 + x0) AS x0, min(y) AS y0, sum(n)::BIGINT AS area, round(sum((x0 + x1) / 2.0 * n) / sum(n), 6) AS cx, round(sum(y * n) / sum(n), 6) AS cy, round(sum(n) / any_value(whole), 6) AS share, bool_or(x0 = 0 OR x1 = 63 OR y = 0 OR y = 63) AS touches_edge FROM (SELECT r.*, least(r.run, coalesce((SELECT min(b) FROM reach WHERE a = r.run), r.run)) AS region, sum(n) OVER (PARTITION BY band) AS whole FROM runs r) GROUP BY band, region", _RUNS_OF, "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"))
def component_stats(spark, sf):
    p = pixels(spark, sf).filter(E.mask_bit(C("mask"), 0) & E.mask_bit(C("mask"), 2))
    return P.component_stats(p, ["band"], 64, 64).select("band", "x0", "y0", "area", *rd("cx", "cy", "share"), "touches_edge")


@query("rasterize_ellipse", with_tables(S, "SELECT source_id AS id, px::INT AS x, py::INT AS y FROM (SELECT source_id, px, py, (cos(theta) * (px - lx) + sin(theta) * (py - y)) / a AS u, (-sin(theta) * (px - lx) + cos(theta) * (py - y)) / b AS v FROM (SELECT *, unnest(range(greatest(0, lx::BIGINT - 12), least(1023, lx::BIGINT + 12) + 1)) AS px FROM (SELECT *, x - patch * 2048 AS lx, unnest(range(greatest(0, y::BIGINT - 12), least(1023, y::BIGINT + 12) + 1)) AS py FROM sources))) WHERE u * u + v * v <= 1 + 1e-9"))
def rasterize_ellipse(spark, sf):
    return P.rasterize_ellipse(sources(spark, sf).selectExpr("source_id AS id", "x - patch * 2048 AS cx", "y AS cy", "a", "b", "theta"), 1024, 1024)


@query("dense_label_priority", with_tables(S, "SELECT x::INT AS x, y::INT AS y, label FROM (SELECT x, y, label, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, label DESC) AS n FROM (SELECT x, y, source_id % 4 AS priority, band AS label FROM (SELECT floor(x / 4) AS x, floor(y / 4) AS y, source_id, band FROM sources))) WHERE n = 1"))
def dense_label_priority(spark, sf):
    claims = sources(spark, sf).selectExpr("1 AS one", "CAST(floor(x / 4) AS INT) AS x", "CAST(floor(y / 4) AS INT) AS y", "source_id % 4 AS priority", "band AS label")
    return P.dense_label_priority(claims, ["one"]).select("x", "y", "label")


@query("bright_region_mask", with_tables(PX, "SELECT DISTINCT p.band, p.x, p.y FROM pixels p JOIN (SELECT band, x, y FROM (SELECT *, (image - avg(image) OVER w) / stddev_pop(image) OVER w AS z FROM pixels WINDOW w AS (PARTITION BY band)) WHERE z > 1.5) c ON c.band = p.band AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 2.25"))
def bright_region_mask(spark, sf):
    return P.bright_region_mask(E.standardize_pixels(pixels(spark, sf), "image", ["band"]), "z", 1.5, 1.5, ["band"])


_LENGTHS = "flat AS (SELECT band, (x * 64 + y)::BIGINT AS p FROM pixels WHERE (mask & 1) <> 0), spans AS (SELECT band, min(p) AS s, max(p) + 1 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY band ORDER BY p) AS k FROM flat) GROUP BY band, k), parts AS (SELECT band, s, e, s - coalesce(lag(e) OVER w, 0) AS off, e - s AS lit, lead(s) OVER w IS NULL AS final FROM spans WINDOW w AS (PARTITION BY band ORDER BY s))"


@query("pixel_mask_runs", with_tables(PX, "SELECT band, string_agg(off || ',' || lit || CASE WHEN final AND e < 4096 THEN ',' || (4096 - e) ELSE '' END, ',' ORDER BY s) AS counts, sum(lit)::BIGINT AS area FROM parts GROUP BY band", _LENGTHS))
def pixel_mask_runs(spark, sf):
    runs = P.pixel_mask_runs(pixels(spark, sf).filter(E.mask_bit(C("mask"), 0)), ["band"], 64, 64)
    return runs.select("band", F.array_join(C("counts").cast("array<string>"), ",").alias("counts"), "area")


def kron_sql(centers: str, reach: tuple[int, int], a: float, b: float, sigma: float) -> str:
    """Table kron of first moments about ``centers`` (id, band, px, py), with spans of ``reach`` pixels, in SQL."""
    cells = f"cells AS (SELECT c.id, px::DOUBLE - c.px AS dx, py::DOUBLE - c.py AS dy, CASE WHEN {sfin('p.image')} THEN p.image ELSE 0.0 END AS i FROM (SELECT *, unnest(range(px - {reach[0]}, px + {reach[0]} + 1)) AS qx FROM (SELECT *, unnest(range(py - {reach[1]}, py + {reach[1]} + 1)) AS qy FROM {centers})) c LEFT JOIN pixels p ON p.band = c.band AND p.x = c.qx AND p.y = c.qy)".replace("px::DOUBLE - c.px", "(c.qx - c.px)::DOUBLE").replace("py::DOUBLE - c.py", "(c.qy - c.py)::DOUBLE")
    radii = f"radii AS (SELECT id, i, far < 0.5 AS central, pow(dx / ({sigma}::DOUBLE * {a}::DOUBLE), 2) + pow(dy / ({sigma}::DOUBLE * {b}::DOUBLE), 2) <= 1 AS inside, CASE WHEN far < 0.5 THEN sqrt(along * along + pow({P.CENTRAL_PIXEL}::DOUBLE * (1 + far / sqrt(2.0::DOUBLE)), 2)) ELSE along END AS r FROM (SELECT *, sqrt(dx * dx + dy * dy) AS far, sqrt(dx * dx + pow(dy * ({a}::DOUBLE / {b}::DOUBLE), 2)) AS along FROM cells))"
    sums = "sums AS (SELECT id, coalesce(sum(i) FILTER (WHERE inside), 0) AS total, coalesce(sum(r * i) FILTER (WHERE inside), 0) AS weighted, coalesce(sum(greatest(i, 0)) FILTER (WHERE inside), 0) AS positive, coalesce(sum(least(i, 0)) FILTER (WHERE inside), 0) AS negative, count(*) FILTER (WHERE inside) AS n, count(*) FILTER (WHERE central) AS central FROM radii GROUP BY id)"
    kron = f"kron AS (SELECT *, CASE WHEN candidate <= sqrt({a}::DOUBLE * {b}::DOUBLE) THEN {sigma}::DOUBLE * sqrt({a}::DOUBLE * {b}::DOUBLE) ELSE candidate END AS radius FROM (SELECT *, CASE WHEN total > 0 AND weighted > 0 THEN weighted / total * sqrt({b}::DOUBLE / {a}::DOUBLE) END AS candidate FROM sums))"
    return f"{cells}, {radii}, {sums}, {kron}"


@query("kron_moment", with_tables(PX, "SELECT id, round(radius, 6) AS radius, round(candidate, 6) AS candidate, round(total) AS total, round(positive) AS positive, round(negative) AS negative, n, central FROM kron", _CENTERS, kron_sql("centers", (5, 3), 2.0, 1.25, 2.0)))
def kron_moment(spark, sf):
    c = centers(pixels(spark, sf))
    spans = c.withColumn("y", F.explode(F.sequence(C("py") - 3, C("py") + 3))).selectExpr("band", "id", "y", "px - 5 AS x0", "px + 5 AS x1")
    shape = c.selectExpr("id", "CAST(px AS DOUBLE) AS cx", "CAST(py AS DOUBLE) AS cy", "2D AS a", "1.25D AS b", "0D AS theta")
    m = P.kron_moment(spans, pixels(spark, sf), shape, ["band"], 2.0)
    return m.select("id", out("radius").alias("radius"), out("candidate").alias("candidate"), *rd("total", "positive", "negative", digits=0), "n", "central")


_FLAG = "CASE source_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"
_LOCAL = f"points AS (SELECT source_id, {_FLAG} AS flag, patch // 4 AS patch, x - patch * 2048 AS x, y FROM sources)"


def local_points(spark, sf):
    """Every source on one of the pixel planes."""
    return sources(spark, sf).selectExpr("source_id", f"{_FLAG} AS flag", "patch div 4 AS patch", "x - patch * 2048 AS x", "y")


@query("point_in_mask", with_tables("sources pixels", "SELECT source_id FROM points s WHERE EXISTS (SELECT 1 FROM pixels p WHERE p.flag = s.flag AND p.patch = s.patch AND (p.mask & 1) <> 0 AND p.x = floor(s.x / 16) AND p.y = floor(s.y / 16))", _LOCAL))
def point_in_mask(spark, sf):
    points = local_points(spark, sf).withColumns({"x": C("x") / 16, "y": C("y") / 16})
    return P.points_in_mask(points, pixels(spark, sf).filter(E.mask_bit(C("mask"), 0)), ["flag", "patch"]).select("source_id")


@query("mask_at_center", with_tables("sources pixels", "SELECT source_id, mask FROM (SELECT source_id, flag, patch, x / 16 AS u, y / 16 AS v FROM points) s LEFT JOIN pixels p ON p.flag = s.flag AND p.patch = s.patch AND p.x = CASE WHEN u - floor(u) = 0.5 THEN 2 * round(u / 2) ELSE round(u) END AND p.y = CASE WHEN v - floor(v) = 0.5 THEN 2 * round(v / 2) ELSE round(v) END", _LOCAL))
def mask_at_center(spark, sf):
    points = local_points(spark, sf).withColumns({"x": C("x") / 16, "y": C("y") / 16})
    return P.mask_at_center(points, pixels(spark, sf), ["flag", "patch"]).select("source_id", "mask")


@query("center_validity", with_tables("sources pixels", "SELECT source_id, coalesce((p.mask & 1) = 0, false) AS valid FROM points s LEFT JOIN pixels p ON p.flag = s.flag AND p.patch = s.patch AND p.x = floor(s.x / 15 + 0.5) AND p.y = floor(s.y / 15 + 0.5)", _LOCAL))
def center_validity(spark, sf):
    points = local_points(spark, sf).withColumns({"x": C("x") / 15, "y": C("y") / 15})
    return P.center_validity(points, pixels(spark, sf), ~E.mask_bit(C("mask"), 0), ["flag", "patch"]).select("source_id", "valid")


@query("candidate_weights", with_tables("samples", "SELECT source, patch, bands, num_samples, round(0.2::DOUBLE + 0.8::DOUBLE * pow(CASE WHEN top > 0 THEN f / top ELSE 0 END, 2), 6) AS weight FROM (SELECT *, max(f) OVER (PARTITION BY source) AS top FROM (SELECT source, patch, count(DISTINCT band) AS bands, sum(num_samples)::BIGINT AS num_samples, sum(CASE WHEN band = 'SMALL' THEN num_samples ELSE 0 END)::DOUBLE / sum(num_samples) AS f FROM samples GROUP BY ALL))"))
def candidate_weights(spark, sf):
    return A.candidate_weights(samples(spark, sf), ["SMALL"]).withColumn("weight", F.round("weight", 6))


@query("selector_summary", with_tables("samples", "SELECT source, count(*) AS samples, sum(num_samples)::BIGINT AS tiles, count(DISTINCT patch) AS patches, count(DISTINCT grp) AS groups FROM samples GROUP BY source"))
def selector_summary(spark, sf):
    return A.selector_summary(samples(spark, sf))


_DRAWN = "ranked AS (SELECT source, patch, -ln((('0x' || substr(md5('3:' || source || ':' || patch), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (0.2::DOUBLE + 0.8::DOUBLE * pow(CASE WHEN top > 0 THEN f / top ELSE 0 END, 2)) AS k FROM (SELECT *, max(f) OVER (PARTITION BY source) AS top FROM (SELECT source, patch, sum(CASE WHEN band = 'SMALL' THEN num_samples ELSE 0 END)::DOUBLE / sum(num_samples) AS f FROM samples GROUP BY ALL)))"


@query("weighted_sample", with_tables("samples", "SELECT source, patch FROM (SELECT *, row_number() OVER (ORDER BY k, source, patch) AS n FROM ranked) WHERE n <= 50", _DRAWN))
def weighted_sample(spark, sf):
    return A.weighted_sample(A.candidate_weights(samples(spark, sf), ["SMALL"]), 50, 3, ["source", "patch"]).select("source", "patch")


@query("train_val_split", with_tables("samples", "SELECT sample_id, CASE WHEN k <= greatest(1, round_even(places * 0.1, 0)) THEN 'validation' ELSE 'train' END AS part FROM samples JOIN (SELECT source, patch, row_number() OVER (ORDER BY md5('7:' || source || ':' || patch), source, patch) AS k, count(*) OVER () AS places FROM (SELECT DISTINCT source, patch FROM samples)) USING (source, patch)"))
def train_val_split(spark, sf):
    return A.train_val_split(samples(spark, sf), 0.1, ["source", "patch"], 7).select("sample_id", "part")


@query("fixed_selectors", with_tables("samples", "SELECT p_partkey AS place, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS source, p_partkey % 2 = 0 AS found FROM part"))
def fixed_selectors(spark, sf):
    wanted = read(spark, sf, "part").selectExpr("p_partkey AS place", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS source")
    return A.fixed_selectors(samples(spark, sf), wanted, "source")


@query("natural_sort", "SELECT row_number() OVER (ORDER BY p_partkey % 12, p_size, p_partkey) AS place, p_partkey, (p_partkey % 12) || ',' || p_size AS patch FROM part")
def natural_sort(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat_ws(",", (C("p_partkey") % 12).cast("string"), C("p_size").cast("string")).alias("patch"))
    return A.natural_sort(p, "patch", "p_partkey").select("place", "p_partkey", "patch")


@query("concat_classes", with_tables(S, "SELECT source_id, area, NULL::DOUBLE AS flux_err FROM sources WHERE f_edge UNION ALL SELECT source_id, NULL, flux_err FROM sources WHERE f_sat"))
def concat_classes(spark, sf):
    s = sources(spark, sf)
    return A.concat_classes([s.filter("f_edge").select("source_id", "area"), s.filter("f_sat").select("source_id", "flux_err")])


@query("unique_targets", with_tables(S, "SELECT source_id, part::INT AS part FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, source_id) AS n FROM (SELECT source_id, x || ':' || y || ':' || band AS k, 0 AS part FROM sources WHERE f_edge UNION ALL SELECT source_id, x || ':' || y || ':' || band, 1 FROM sources WHERE c % 3 = 0)) WHERE n = 1"))
def unique_targets(spark, sf):
    s = sources(spark, sf).select("source_id", "x", "y", "band", "f_edge", "c")
    key = F.struct(F.bround(C("x") * 1000).cast("long"), F.bround(C("y") * 1000).cast("long"), "band")
    return A.unique_targets([s.filter("f_edge"), s.filter("c % 3 = 0")], key).select("source_id", "part")


@query("merge_rebuilt", with_tables(S, "SELECT source_id, band, 'stored' AS origin FROM sources WHERE band NOT IN (SELECT band FROM sources WHERE source_id % 1000 = 1) UNION ALL SELECT source_id, band, 'rebuilt' FROM sources WHERE source_id % 1000 = 1"))
def merge_rebuilt(spark, sf):
    s = sources(spark, sf).select("source_id", "band")
    return A.merge_rebuilt(s.withColumn("origin", F.lit("stored")), s.filter("source_id % 1000 = 1").withColumn("origin", F.lit("rebuilt")), ["band"])


@query("label_override", with_tables("sources refit", "SELECT s.source_id, coalesce(CASE WHEN r.good THEN 'external' END, s.band) AS class FROM sources s LEFT JOIN refit r USING (source_id)"))
def label_override(spark, sf):
    from lumenfold.plans.tables import refit

    labels = refit(spark, sf).filter("good").select("source_id", F.lit("external").alias("new_class"))
    return A.label_override(sources(spark, sf).select("source_id", C("band").alias("class")), labels)


@query("id_set_algebra", with_tables(S, "SELECT * FROM (SELECT 'both' AS kind, count(*) AS n FROM (SELECT user_id FROM sources WHERE band = 'view' INTERSECT SELECT user_id FROM sources WHERE band = 'error') UNION ALL SELECT 'only_a', count(*) FROM (SELECT user_id FROM sources WHERE band = 'view' EXCEPT SELECT user_id FROM sources WHERE band = 'error') UNION ALL SELECT 'only_b', count(*) FROM (SELECT user_id FROM sources WHERE band = 'error' EXCEPT SELECT user_id FROM sources WHERE band = 'view')) WHERE n > 0"))
def id_set_algebra(spark, sf):
    s = sources(spark, sf)
    return A.id_set_algebra(s.filter("band = 'view'"), s.filter("band = 'error'"), "user_id")


# The second of two starts moves from 368 to the edge.
_TILE_STARTS = "starts AS (SELECT i, i * 512 AS at FROM (SELECT unnest(range(2)) AS i))"


@query("tile_grid", with_tables(S, "SELECT source_id, c.i::INT AS col, r.i::INT AS row FROM (SELECT source_id, x - patch * 2048 AS lx, y FROM sources) JOIN starts c ON lx >= c.at AND lx < c.at + 512 JOIN starts r ON y >= r.at AND y < r.at + 512", _TILE_STARTS))
def tile_grid(spark, sf):
    s = sources(spark, sf).selectExpr("source_id", "x - patch * 2048 AS x", "y")
    return A.tile_of(s, A.tile_grid(spark, 1024, 1024, 512, 368)).select("source_id", "col", "row")


@query("confidence_points", r(f"SELECT source_id, x, y FROM rich WHERE {sfin('snr')} AND snr > 5"))
def confidence_points(spark, sf):
    return R.confidence_points(rich(spark, sf), C("snr"), F.lit(False)).select("source_id", "x", "y")


@query("id_pairs_matched", with_tables(SD, "SELECT count(*) AS pairs, count(DISTINCT a) AS detections, count(DISTINCT b) AS sources FROM near", NEAR))
def id_pairs_matched(spark, sf):
    return det_pairs(spark, sf).agg(F.count("*").alias("pairs"), F.countDistinct("a").alias("detections"), F.countDistinct("b").alias("sources"))
