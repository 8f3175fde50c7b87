"""Queries of the scalar expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.plans.registry import query
from lumenfold.plans.tables import out, pixels, read, refit, sfin, smag, sources, sout, with_tables

S = "sources"
C = F.col
NAN = "'NaN'::DOUBLE"
PI = repr(math.pi)


@query("coalesce_finite", with_tables(S, f"SELECT source_id, {sout('coalesce(CASE WHEN ' + sfin('flux') + ' THEN flux END, CASE WHEN ' + sfin('ap_flux') + ' THEN ap_flux END)')} AS v FROM sources"))
def coalesce_finite(spark, sf):
    s = sources(spark, sf)
    return s.select("source_id", out(E.coalesce_finite(s, ["absent", "flux", "ap_flux"])).alias("v"))


@query("first_usable_column", with_tables(S, "SELECT source_id, round(ap_flux, 6) AS v FROM (SELECT *, 'NaN'::DOUBLE AS empty FROM sources)"))
def first_usable_column(spark, sf):
    s = sources(spark, sf).withColumn("empty", F.lit(E.NAN))
    return s.select("source_id", F.round(E.first_usable_column(s, ["absent", "empty", "ap_flux", "flux"]), 6).alias("v"))


@query("flux_to_mag", with_tables(S, f"SELECT source_id, {sout(smag('flux'))} AS mag FROM sources"))
def flux_to_mag(spark, sf):
    return sources(spark, sf).select("source_id", out(E.flux_to_mag("flux")).alias("mag"))


@query("recalibrate_mag", with_tables(S, f"SELECT source_id, {sout('CASE WHEN ' + sfin('flux') + f' THEN flux * {10 ** (4.4 / 2.5)!r}::DOUBLE ELSE {NAN} END')} AS njy, {sout(smag('flux', 27.0))} AS mag FROM sources"))
def recalibrate_mag(spark, sf):
    s = E.recalibrate_mag(sources(spark, sf), [("flux", "njy", "mag")], 27.0)
    return s.select("source_id", out("njy").alias("njy"), out("mag").alias("mag"))


_FLOOR = "(SELECT *, greatest(xx, 0.25::DOUBLE) AS p, greatest(yy, 0.25::DOUBLE) AS q FROM sources)"
_SPREAD = "sqrt((p - q) * (p - q) + 4.0::DOUBLE * xy * xy)"
_MAJOR = f"sqrt(greatest(0.5::DOUBLE * (p + q + {_SPREAD}), 0.25::DOUBLE))"
_MINOR = f"sqrt(greatest(0.5::DOUBLE * (p + q - {_SPREAD}), 0.25::DOUBLE))"
_THETA = "0.5::DOUBLE * atan2(2.0::DOUBLE * xy, p - q)"


@query("moments_to_ellipse", with_tables(S, f"SELECT source_id, round({_MAJOR}, 6) AS major, round({_MINOR}, 6) AS minor, round({_THETA}, 6) AS theta FROM {_FLOOR}"))
def moments_to_ellipse(spark, sf):
    major, minor, theta = E.moments_to_ellipse(C("xx"), C("yy"), C("xy"))
    return sources(spark, sf).select("source_id", out(major).alias("major"), out(minor).alias("minor"), out(theta).alias("theta"))


_D = "sqrt((xx - yy) * (xx - yy) + 4.0::DOUBLE * xy * xy)"
_OK = f"(0.5::DOUBLE * (xx + yy + {_D}) > 0 AND 0.5::DOUBLE * (xx + yy - {_D}) > 0)"


@query("moments_to_ellipse_strict", with_tables(S, f"SELECT source_id, CASE WHEN {_OK} THEN round(sqrt(0.5::DOUBLE * (xx + yy + {_D})), 6) END AS major, CASE WHEN {_OK} THEN round(sqrt(0.5::DOUBLE * (xx + yy - {_D})), 6) END AS minor FROM sources"))
def moments_to_ellipse_strict(spark, sf):
    major, minor, _ = E.moments_to_ellipse(C("xx"), C("yy"), C("xy"), None)
    return sources(spark, sf).select("source_id", out(major).alias("major"), out(minor).alias("minor"))


@query("kron_ellipse", with_tables("sources refit", f"""SELECT source_id, CASE WHEN ok THEN round(ka, 6) END AS a, CASE WHEN ok THEN round(kb, 6) END AS b, CASE WHEN ok THEN round({PI}::DOUBLE * ka * kb, 4) END AS area FROM (
SELECT source_id, greatest(major * (radius / sqrt(major * minor)) * 2.0::DOUBLE, 1.5::DOUBLE) AS ka, greatest(minor * (radius / sqrt(major * minor)) * 2.0::DOUBLE, 1.5::DOUBLE) AS kb, radius > 0 AND coalesce(good, false) AS ok
FROM (SELECT s.*, r.radius, r.good, {_MAJOR} AS major, {_MINOR} AS minor FROM {_FLOOR} s LEFT JOIN refit r USING (source_id)))"""))
def kron_ellipse(spark, sf):
    s = sources(spark, sf).join(refit(spark, sf), "source_id", "left")
    a, b, _, area = E.kron_ellipse(*E.moments_to_ellipse(C("xx"), C("yy"), C("xy")), C("radius"), 2.0, 1.5, C("good"))
    return s.select("source_id", out(a).alias("a"), out(b).alias("b"), out(area, 4).alias("area"))


@query("axis_ratio", with_tables(S, "SELECT source_id, round(greatest(abs(a), abs(xy)) / least(abs(a), abs(xy)), 6) AS ratio FROM (SELECT source_id, a, nullif(xy, 0) AS xy FROM sources) WHERE xy IS NOT NULL UNION ALL SELECT source_id, NULL FROM sources WHERE xy = 0"))
def axis_ratio(spark, sf):
    return sources(spark, sf).select("source_id", out(E.axis_ratio(C("a"), C("xy"))).alias("ratio"))


@query("ap_snr", with_tables(S, f"SELECT source_id, CASE WHEN {sfin('flux')} THEN round(flux / flux_err, 6) END AS snr FROM sources"))
def ap_snr(spark, sf):
    return sources(spark, sf).select("source_id", out(E.snr(C("flux"), C("flux_err"))).alias("snr"))


@query("fill_ratio", with_tables(S, "SELECT source_id, round(pixels_in / area, 6) AS fill FROM sources"))
def fill_ratio(spark, sf):
    return sources(spark, sf).select("source_id", out(E.fill_ratio(C("pixels_in"), C("area"))).alias("fill"))


_T = f"CASE WHEN {sfin('flux')} AND flux > 0 AND xx > 0 AND yy > 0 THEN least(xx * 4.0::DOUBLE / yy, 1.5::DOUBLE) END"


@query("snr_from_variance", with_tables(S, f"SELECT source_id, round(flux * sqrt(t), 6) AS snr, round(t, 6) AS t FROM (SELECT source_id, flux, {_T} AS t FROM sources)"))
def snr_from_variance(spark, sf):
    snr, t = E.snr_from_variance(C("flux"), C("xx"), C("yy"), 2.0, 1.5)
    return sources(spark, sf).select("source_id", out(snr).alias("snr"), out(t).alias("t"))


_W = "0.2::DOUBLE * least((source_id % 7)::DOUBLE / 5.0::DOUBLE, 1.0::DOUBLE)"


@query("snr_from_weight_ratio", with_tables(S, f"""SELECT source_id, CASE WHEN source_id % 7 > 0 AND {sfin('flux')} AND flux > 0 THEN round(flux * sqrt(least({_W}, 1.0::DOUBLE)), 6) END AS snr,
CASE WHEN source_id % 7 > 0 AND {sfin('flux')} AND flux > 0 AND source_id % 11 > 0 THEN round(flux * sqrt(least({_W} / least((source_id % 11)::DOUBLE / 10.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE)), 6) END AS snr_ref FROM sources"""))
def snr_from_weight_ratio(spark, sf):
    local, ref = F.expr("CAST(source_id % 7 AS DOUBLE)"), F.expr("CAST(source_id % 11 AS DOUBLE)")
    w = lambda **k: E.snr_from_weight_ratio(C("flux"), F.lit(10.0), F.lit(2.0), F.lit(5.0), local, **k)[0]
    return sources(spark, sf).select("source_id", out(w()).alias("snr"), out(w(reference=ref, reference_count=F.lit(10.0))).alias("snr_ref"))


@query("unpack_flags", with_tables(S, "SELECT source_id, f_edge AS edge, f_sat AS sat, false AS gone FROM sources"))
def unpack_flags(spark, sf):
    s = sources(spark, sf).withColumn("flags", F.array("f_bad", "f_sat"))
    bits = {"bad": 0, "sat": 1}
    return s.select("source_id", E.unpack_flag(s, "f_edge", bits).alias("edge"), E.unpack_flag(s, "sat", bits).alias("sat"), E.unpack_flag(s, "gone", bits).alias("gone"))


_PLANES = {"BAD": 0, "SAT": 1, "CR": 3, "EDGE": 4}


@query("mask_bits", with_tables(S, "SELECT source_id, (mask & 2) <> 0 AS sat, concat_ws(';', CASE WHEN (mask & 1) <> 0 THEN 'BAD' END, CASE WHEN (mask & 2) <> 0 THEN 'SAT' END, CASE WHEN (mask & 8) <> 0 THEN 'CR' END, CASE WHEN (mask & 16) <> 0 THEN 'EDGE' END) AS hits FROM sources"))
def mask_bits(spark, sf):
    return sources(spark, sf).select("source_id", E.mask_bit(C("mask"), 1).alias("sat"), E.mask_hits(C("mask"), _PLANES).alias("hits"))


_SCORE = "greatest(0.0::DOUBLE, CASE WHEN (mask & 1) <> 0 AND NOT everywhere THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN (mask & 2) <> 0 THEN 0.4::DOUBLE ELSE 0 END, CASE WHEN (mask & 4) <> 0 THEN 0.15::DOUBLE ELSE 0 END)"


@query("bad_score", with_tables("pixels", f"SELECT band, x, y, {_SCORE} AS score FROM pixels JOIN (SELECT band, bool_and((mask & 1) <> 0 AND {sfin('image')}) AS everywhere FROM pixels GROUP BY band) USING (band)"))
def bad_score(spark, sf):
    p = pixels(spark, sf)
    everywhere = p.groupBy("band").agg(F.bool_and(E.mask_bit(C("mask"), 0) & E.finite("image")).alias("everywhere"))
    planes = {"BAD": 0, "SAT": 1, "CR": 2}
    return p.join(everywhere, "band").select("band", "x", "y", E.bad_score(C("mask"), planes, {"BAD": 1.0, "SAT": 0.4, "CR": 0.15}, C("everywhere")).alias("score"))


@query("score_category", with_tables(S, "SELECT source_id, CASE WHEN v >= 0.5 THEN 'gt_50' WHEN v >= 0.2 THEN '20_50' WHEN v >= 0.1 THEN '10_20' WHEN v >= 0.05 THEN '5_10' ELSE 'lt_5' END AS category FROM (SELECT source_id, (source_id % 101)::DOUBLE / 100::DOUBLE AS v FROM sources)"))
def score_category(spark, sf):
    return sources(spark, sf).select("source_id", E.score_category(F.expr("CAST(source_id % 101 AS DOUBLE) / 100D")).alias("category"))


@query("area_equivalent", with_tables(S, "SELECT source_id, v > 900 AND abs(v - 900) > 9e-12 AS faint_large, round(v, 6) AS area FROM (SELECT source_id, area * 1.4172335600907029::DOUBLE AS v FROM sources)"))
def area_equivalent(spark, sf):
    v = E.area_equivalent(C("area"), 0.2)
    return sources(spark, sf).select("source_id", E.exceeds(v, 900.0).alias("faint_large"), F.round(v, 6).alias("area"))


@query("star_evidence", with_tables(S, f"SELECT source_id, (flux_err > 0 AND {sfin('flux')} AND flux / flux_err >= 3) OR sqrt(xx * xx + yy * yy) >= 3 OR sqrt((xx / a) * (xx / a) + (yy / b) * (yy / b)) >= 3 AS star FROM sources"))
def star_evidence(spark, sf):
    s = sources(spark, sf).select("source_id", C("flux").alias("parallax"), C("flux_err").alias("parallax_error"), C("xx").alias("pmra"), C("a").alias("pmra_error"), C("yy").alias("pmdec"), C("b").alias("pmdec_error"))
    return s.select("source_id", E.star_evidence(s).alias("star"))


@query("extendedness_class", with_tables(S, "SELECT source_id, CASE WHEN extendedness IS NULL THEN 'unknown' WHEN extendedness < 0.5 THEN 'star' ELSE 'galaxy' END AS kind FROM sources"))
def extendedness_class(spark, sf):
    return sources(spark, sf).select("source_id", E.extendedness_class(C("extendedness")).alias("kind"))


def _delta(a: str, b: str) -> str:
    v = f"({a} - {b} + {math.pi / 2!r}::DOUBLE)"
    return f"abs({v} - floor({v} / {PI}::DOUBLE) * {PI}::DOUBLE - {math.pi / 2!r}::DOUBLE)"


@query("angle_delta", with_tables(S, f"SELECT source_id, round({_delta('theta', 'a')}, 6) AS delta FROM sources"))
def angle_delta(spark, sf):
    return sources(spark, sf).select("source_id", F.round(E.angle_delta(C("theta"), C("a")), 6).alias("delta"))


def _l1(v: str) -> str:
    return f"(CASE WHEN abs({v}) < 1 THEN 0.5::DOUBLE * ({v}) * ({v}) ELSE abs({v}) - 0.5::DOUBLE END)"


@query("shape_distance", with_tables(S, f"SELECT source_id, round((2.0::DOUBLE * ({_l1('ln(a / b) - ln((a + 1) / b)')} + {_l1(f'ln(area / {PI}::DOUBLE) - ln((area + a) / {PI}::DOUBLE)')}) + 0.5::DOUBLE * (1.0::DOUBLE - cos(2.0::DOUBLE * {_delta('theta', 'xx')}))) / 2.5::DOUBLE, 6) AS distance FROM sources"))
def shape_distance(spark, sf):
    d = E.shape_distance(C("area"), C("a"), C("b"), C("theta"), C("area") + C("a"), C("a") + 1, C("b"), C("xx"), 0.5)
    return sources(spark, sf).select("source_id", F.round(d, 6).alias("distance"))


@query("ellipse_contains", with_tables(S, "SELECT source_id, round(u * u + v * v, 6) AS form, u * u + v * v <= 1.0 AS inside FROM (SELECT source_id, (cos(theta) * xx + sin(theta) * yy) / a AS u, (-sin(theta) * xx + cos(theta) * yy) / b AS v FROM sources)"))
def ellipse_contains(spark, sf):
    args = (C("x") + C("xx"), C("y") + C("yy"), C("x"), C("y"), C("a"), C("b"), C("theta"), C("turn"))
    return sources(spark, sf).withColumn("turn", E.turned("theta")).select("source_id", F.round(E.ellipse_form(*args), 6).alias("form"), E.ellipse_contains(*args).alias("inside"))


_NAME = "concat('group_', lpad(CAST(event_id % 30 AS STRING), 2, '0'), '_grid_r', lpad(CAST(user_id % 20 AS STRING), 2, '0'), '_c', lpad(CAST(event_id % 11 AS STRING), 2, '0'), '_x', event_id, '_y', user_id)"


@query("parse_tile_name", "SELECT event_id, (event_id % 30)::INT AS grp, (user_id % 20)::INT AS row, (event_id % 11)::INT AS col, event_id::INT AS x0, user_id::INT AS y0, 'grid_r' || lpad((user_id % 20)::VARCHAR, 2, '0') || '_c' || lpad((event_id % 11)::VARCHAR, 2, '0') || '_x' || event_id || '_y' || user_id AS bare FROM events")
def parse_tile_name(spark, sf):
    e = read(spark, sf, "events").withColumn("name", F.expr(_NAME))
    return e.select("event_id", *[c.alias(n) for n, c in E.parse_tile_name(C("name")).items()])


@query("parse_selector", "SELECT p_partkey, p_brand AS source, p_size::VARCHAR AS tract, p_type AS patch, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'group_' || lpad((p_partkey % 40)::VARCHAR, 2, '0') ELSE 'random' END AS grp FROM part")
def parse_selector(spark, sf):
    p = read(spark, sf, "part").withColumn("text", F.expr("concat(replace(p_brand, '#', '~'), ':', p_size, '/', p_type, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN concat('@', p_partkey % 40) ELSE '@random' END, CASE WHEN p_partkey % 2 = 0 THEN '  # note' ELSE '' END)"))
    found = E.parse_selector(C("text"))
    found["source"] = F.replace(found["source"], F.lit("~"), F.lit("#"))
    return p.select("p_partkey", *[c.alias(n) for n, c in found.items()])


_BANDS = ["click", "error", "purchase", "signup", "view"]
_PATTERN = " || ".join(f"CASE WHEN bool_or(band = '{b}') THEN '1' ELSE '0' END" for b in _BANDS)


@query("band_pattern", with_tables(S, f"SELECT user_id, pattern, regexp_matches(pattern, '10+1') AS hole FROM (SELECT user_id, {_PATTERN} AS pattern FROM sources GROUP BY user_id)"))
def band_pattern(spark, sf):
    g = sources(spark, sf).groupBy("user_id").agg(F.collect_set("band").alias("bands"))
    g = g.withColumn("pattern", E.band_pattern(C("bands"), _BANDS))
    return g.select("user_id", "pattern", E.pattern_hole(C("pattern")).alias("hole"))


@query("reason_string", with_tables(S, "SELECT source_id, concat_ws(';', CASE WHEN f_bad THEN 'bad' END, CASE WHEN f_edge OR f_sat THEN 'edge' END, CASE WHEN NOT detect_isPrimary THEN 'not_primary' END) AS reason FROM sources"))
def reason_string(spark, sf):
    parts = F.array(F.when(C("f_sat"), "edge"), F.when(~C("detect_isPrimary"), "not_primary"), F.when(C("f_edge"), "edge"), F.when(C("f_bad"), "bad"))
    return sources(spark, sf).select("source_id", E.reason_string(parts).alias("reason"))


@query("standardize_pixels", with_tables("pixels", "SELECT band, x, y, round((image - avg(image) OVER w) / stddev_pop(image) OVER w, 6) AS z FROM pixels WINDOW w AS (PARTITION BY band)"))
def standardize_pixels(spark, sf):
    return E.standardize_pixels(pixels(spark, sf), "image", ["band"]).select("band", "x", "y", F.round("z", 6).alias("z"))


@query("log_scale", with_tables("pixels", "SELECT band, x, y, round(ln(1 + 300.0::DOUBLE * least(greatest((image - 1000) / (hi - 1000), 0), 1)) / ln(300.0::DOUBLE), 6) AS scaled FROM pixels JOIN (SELECT band, quantile_cont(image, 0.99) AS hi FROM pixels GROUP BY band) USING (band)"))
def log_scale(spark, sf):
    return E.log_scale(pixels(spark, sf), "image", ["band"], 1000.0).select("band", "x", "y", F.round("scaled", 6).alias("scaled"))


@query("anscombe_scale", with_tables("pixels", "SELECT band, x, y, round(2.0::DOUBLE * sqrt((image - min(image) OVER (PARTITION BY band)) * 0.5::DOUBLE + 0.375::DOUBLE), 6) AS scaled FROM pixels"))
def anscombe_scale(spark, sf):
    return E.anscombe_scale(pixels(spark, sf), "image", ["band"], 0.5).select("band", "x", "y", F.round("scaled", 6).alias("scaled"))
