"""Queries of the filters and class rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import expr as E
from lumenfold.operators import rules as R
from lumenfold.plans.registry import query
from lumenfold.plans.tables import out, refit, sfin, smag, sources, sout, with_tables

S = "sources"
C = F.col
_MAG, _DIFF = smag("flux"), f"({smag('ap_flux')} - {smag('kron_flux')})"
#: The sources with what the rules look at.
_RICH_SQL = f"rich AS (SELECT *, {_MAG} AS mag, {_DIFF} AS diff, flux / flux_err AS snr, pixels_in / area AS fill, greatest(a, b) / least(a, b) AS ratio, area * 8.0::DOUBLE AS big, CASE WHEN source_id % 6 = 0 THEN 500.0::DOUBLE WHEN source_id % 6 = 1 THEN 2000.0::DOUBLE ELSE 0.0::DOUBLE END AS component FROM sources)"


def rich(spark, sf):
    return sources(spark, sf).withColumns({"mag": E.flux_to_mag("flux"), "diff": E.flux_to_mag("ap_flux") - E.flux_to_mag("kron_flux"), "snr": C("flux") / C("flux_err"), "fill": E.fill_ratio(C("pixels_in"), C("area")), "ratio": E.axis_ratio(C("a"), C("b")), "big": C("area") * 8.0, "component": F.when(C("source_id") % 6 == 0, 500.0).when(C("source_id") % 6 == 1, 2000.0).otherwise(0.0)})


def r(statement: str, names: str = S) -> str:
    return with_tables(names, statement, _RICH_SQL)


def gt(c: str, v) -> str:
    return f"({sfin(c)} AND {c} > {v})"


def ge(c: str, v) -> str:
    return f"({sfin(c)} AND {c} >= {v})"


def lt(c: str, v) -> str:
    return f"({sfin(c)} AND {c} < {v})"


@query("source_filter", with_tables(S, "SELECT source_id, 'parent' AS mode FROM sources WHERE parent = 0 UNION ALL SELECT source_id, 'nchild0' FROM sources WHERE n_child = 0 UNION ALL SELECT source_id, 'leaf_child' FROM sources WHERE parent <> 0 AND n_child = 0"))
def source_filter(spark, sf):
    s = sources(spark, sf)
    parts = [R.source_filter(s, m).select("source_id", F.lit(m).alias("mode")) for m in ("parent", "nchild0", "leaf_child")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flag_filter", with_tables(S, "SELECT source_id, f_edge OR f_bad OR NOT detect_isPrimary AS removed_any, f_edge AND f_bad AND NOT detect_isPrimary AS removed_all, concat_ws(';', CASE WHEN f_bad THEN 'bad' END, CASE WHEN NOT detect_isPrimary THEN 'detect_isPrimary' END, CASE WHEN f_edge THEN 'edge' END) AS reasons FROM sources"))
def flag_filter(spark, sf):
    flags = {"edge": C("f_edge"), "bad": C("f_bad"), "detect_isPrimary": C("detect_isPrimary")}
    removed, reasons = R.flag_rule(flags)
    return sources(spark, sf).select("source_id", removed.alias("removed_any"), R.flag_rule(flags, "all")[0].alias("removed_all"), E.reason_string(reasons).alias("reasons"))


@query("area_policy_filter", with_tables(S, "SELECT source_id, area <= 400 AS small, area < 400 OR (area < 900 AND NOT f_bright) AS kept FROM sources"))
def area_policy_filter(spark, sf):
    return sources(spark, sf).select("source_id", R.area_policy(C("area"), C("f_bright"), "max_area").alias("small"), R.area_policy(C("area"), C("f_bright"), "area400_or_area900_not_bright").alias("kept"))


@query("a_filter", r(f"SELECT source_id, big > 10000 AS dropped, big > 900 AND {gt('mag', 25)} AS failed FROM rich"))
def a_filter(spark, sf):
    dropped, failed = R.a_rule(C("big"), C("mag"), R.ClassPolicy(faint_mag_min=25.0))
    return rich(spark, sf).select("source_id", dropped.alias("dropped"), failed.alias("failed"))


_LIMIT = "CASE WHEN component >= 1000 THEN NULL WHEN component > 0 THEN 2.0 ELSE 1.0 END"


@query("bright_ap2_rule", r(f"SELECT source_id, coalesce(CASE WHEN {sfin('diff')} THEN abs(diff) >= ({_LIMIT}) ELSE false END, false) AS removed, coalesce(CASE WHEN {sfin('diff')} THEN abs(diff) >= ({_LIMIT}) ELSE ({_LIMIT}) IS NOT NULL END, false) AS removed_strict FROM rich"))
def bright_ap2_rule(spark, sf):
    return rich(spark, sf).select("source_id", R.bright_ap2_rule(C("diff"), C("component"), False).alias("removed"), R.bright_ap2_rule(C("diff"), C("component"), True).alias("removed_strict"))


_ORD = f"(NOT {lt('mag', 22)})"
_B = f"({_ORD} AND NOT ({ge('mag', 22)} AND mag <= 28)) OR {gt('ratio', 6)} OR ({_ORD} AND NOT ({sfin('diff')} AND abs(diff) < 1)) OR ({_ORD} AND (f_edge OR f_bad))"


@query("b_filter", r(f"SELECT source_id, {_B} AS removed FROM rich"))
def b_filter(spark, sf):
    return rich(spark, sf).select("source_id", R.b_rule(C("mag"), C("ratio"), C("diff"), F.lit(True), C("f_edge") | C("f_bad")).alias("removed"))


@query("fill_center_only", r("SELECT source_id, area > 500 AND fill < 0.3 AS center_only FROM rich"))
def fill_center_only(spark, sf):
    return rich(spark, sf).select("source_id", R.fill_center_only(C("area"), C("fill")).alias("center_only"))


_CLS = "CASE source_id % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'center_only' WHEN 2 THEN 'strict_center_only' WHEN 3 THEN 'ignore' ELSE 'clean' END"
_BANDS = ["click", "error", "purchase", "signup", "view"]


def classed(spark, sf):
    return rich(spark, sf).withColumns({"class": F.expr(_CLS), "reason": F.when(C("f_bad"), "bad").otherwise("")})


@query("saturation_demote", r(f"SELECT source_id, CASE WHEN hit THEN 'strict_center_only' ELSE class END AS class, CASE WHEN hit THEN concat_ws(';', nullif(reason, ''), 'saturated') ELSE reason END AS reason FROM (SELECT *, class = 'clean' AND {lt('mag', '22.5 + length(band) / 4.0::DOUBLE')} AS hit FROM (SELECT *, {_CLS} AS class, CASE WHEN f_bad THEN 'bad' ELSE '' END AS reason FROM rich))"))
def saturation_demote(spark, sf):
    c = classed(spark, sf)
    limits = c.select("band").distinct().withColumn("limit", 22.5 + F.length("band") / 4.0)
    return R.saturation_demote(c, limits).select("source_id", "class", "reason")


@query("snr_class", r(f"SELECT source_id, CASE WHEN {gt('snr', 'hi')} THEN 'clean' WHEN {gt('snr', 'lo')} THEN 'weak_shape' ELSE 'ignore' END AS plain, CASE WHEN {gt('snr', 'lo')} AND snr <= 10 AND area > 500 THEN 'weak_shape' WHEN {gt('snr', 'hi')} THEN 'clean' WHEN {gt('snr', 'lo')} THEN 'weak_shape' ELSE 'ignore' END AS by_area FROM (SELECT *, CASE WHEN band = 'view' THEN 3 ELSE 5 END AS lo, CASE WHEN band = 'view' THEN 5 ELSE 7 END AS hi FROM rich)"))
def snr_class(spark, sf):
    narrow = C("band") == "view"
    return rich(spark, sf).select("source_id", R.snr_class(C("snr"), narrow).alias("plain"), R.snr_class(C("snr"), narrow, C("area")).alias("by_area"))


@query("snr_post_filter", r(f"SELECT source_id, CASE WHEN NOT {sfin('snr')} OR snr <= 3 OR class = 'ignore' THEN 'ignore' WHEN area > 500 AND snr <= 7 THEN 'center_only' WHEN class = 'clean' AND snr < 5 THEN 'center_only' WHEN class = 'strict_center_only' THEN 'center_only' ELSE class END AS class, CASE WHEN NOT {sfin('snr')} THEN 'snr_invalid' WHEN snr <= 3 THEN 'snr_low' WHEN class = 'ignore' THEN 'kept_ignore' WHEN area > 500 AND snr <= 7 THEN 'large_area' WHEN class = 'clean' AND snr < 5 THEN 'clean_low' ELSE 'kept' END AS reason FROM (SELECT *, {_CLS} AS class FROM rich)"))
def snr_post_filter(spark, sf):
    cls, reason = R.snr_post_filter(C("class"), C("snr"), C("area"))
    return classed(spark, sf).select("source_id", cls.alias("class"), reason.alias("reason"))


@query("visibility_class", r(f"SELECT source_id, CASE WHEN mask < 2 THEN 'center_only' WHEN {ge('snr', 3)} THEN 'normal' WHEN {ge('snr', 2)} THEN 'center_only' ELSE 'ignore' END AS visibility FROM rich"))
def visibility_class(spark, sf):
    return rich(spark, sf).select("source_id", R.visibility_class(C("snr"), C("mask")).alias("visibility"))


@query("visibility_keep", r(f"SELECT source_id, 'snr_ge2' AS mode FROM rich WHERE {ge('snr', 2)} UNION ALL SELECT source_id, 'snr_ge3' FROM rich WHERE {ge('snr', 3)}"))
def visibility_keep(spark, sf):
    s = rich(spark, sf)
    return R.visibility_keep(s, "snr_ge2").select("source_id", F.lit("snr_ge2").alias("mode")).unionByName(R.visibility_keep(s, "snr_ge3").select("source_id", F.lit("snr_ge3").alias("mode")))


@query("refit_row_select", r(f"SELECT source_id, round(mag, 6) AS mag FROM rich WHERE {ge('mag', 21)} AND mag <= 27 AND detect_isPrimary AND NOT f_edge AND NOT f_bad AND n_child = 0 AND xx * yy - xy * xy > 0"))
def refit_row_select(spark, sf):
    return R.refit_row_select(rich(spark, sf), 21.0, 27.0).select("source_id", F.round("mag", 6).alias("mag"))


@query("snr_row_filter", r(f"SELECT source_id, CASE WHEN source_id % 3 > 0 THEN 1 ELSE 7 END AS class_id FROM rich WHERE {ge('snr', 20)} OR NOT (source_id % 3 > 0)"))
def snr_row_filter(spark, sf):
    return R.snr_row_filter(rich(spark, sf).withColumn("trusted", C("source_id") % 3 > 0), 20.0).select("source_id", "class_id")


@query("ap2_kron_split", r(f"SELECT source_id, CASE WHEN NOT {sfin('diff')} THEN 'invalid' WHEN abs(diff) <= 0.5 THEN 'kept' ELSE 'rejected' END AS split FROM rich"))
def ap2_kron_split(spark, sf):
    return R.ap2_kron_split(rich(spark, sf), 0.5).select("source_id", "split")


@query("pixel_rounding", with_tables(S, "SELECT source_id, floor(v + 0.5)::INT AS half_up, (CASE WHEN v - floor(v) = 0.5 THEN 2 * round(v / 2) ELSE round(v) END)::INT AS half_even FROM (SELECT source_id, xx AS v FROM sources)"))
def pixel_rounding(spark, sf):
    return sources(spark, sf).select("source_id", R.pixel_half_up(C("xx")).alias("half_up"), R.pixel_half_even(C("xx")).alias("half_even"))


_R3 = "CASE {} WHEN 'clean' THEN 3 WHEN 'weak' THEN 2 WHEN 'strict' THEN 1 ELSE 0 END"
_K1 = "CASE source_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'weak' WHEN 2 THEN 'strict' ELSE 'ignore' END"
_K2 = "CASE source_id % 7 WHEN 0 THEN 'clean' WHEN 1 THEN 'weak' WHEN 2 THEN 'strict' WHEN 3 THEN 'ignore' END"


@query("downgrade", with_tables(S, f"SELECT source_id, CASE WHEN down THEN k2 ELSE k1 END AS class, CASE WHEN down THEN 'new' ELSE 'old' END AS reason FROM (SELECT source_id, k1, k2, k2 IS NOT NULL AND {_R3.format('k2')} < {_R3.format('k1')} AS down FROM (SELECT source_id, {_K1} AS k1, {_K2} AS k2 FROM sources))"))
def downgrade(spark, sf):
    both = lambda k, why: F.struct(F.expr(k).alias("class"), F.lit(why).alias("reason"))
    return sources(spark, sf).select("source_id", R.downgrade(both(_K1, "old"), both(_K2, "new")).alias("r")).select("source_id", "r.class", "r.reason")


@query("category_tags", r(f"SELECT source_id, concat_ws(';', CASE WHEN {gt('ratio', 3)} THEN 'elongated' END, CASE WHEN area > 900 THEN 'large_area' END, CASE WHEN f_sat THEN 'saturated' END) AS tags FROM rich"))
def category_tags(spark, sf):
    return rich(spark, sf).select("source_id", R.category_tags({"large_area": R.above(C("area"), 900.0), "elongated": R.above(C("ratio"), 3.0), "saturated": C("f_sat")}).alias("tags"))


@query("contract_check", with_tables(S, "SELECT 'column:source_id' AS name, true AS ok UNION ALL SELECT 'column:flux', true UNION ALL SELECT 'column:gone', false UNION ALL SELECT 'rows', count(*) > 0 FROM sources UNION ALL SELECT 'unique', count(*) = count(DISTINCT source_id) FROM sources"))
def contract_check(spark, sf):
    return R.contract_check(sources(spark, sf), {"source_id": "bigint", "flux": "double", "gone": "int"}, ["source_id"])


@query("refit_attach", with_tables("sources refit", f"SELECT source_id, r.radius AS radius, r.source_id IS NOT NULL AS matched, {sout('pixel_count / footprint_area')} AS fill FROM sources s LEFT JOIN (SELECT * FROM refit WHERE good AND radius > 0) r USING (source_id)"))
def refit_attach(spark, sf):
    from lumenfold.operators import joins as J

    s = J.refit_attach(sources(spark, sf), refit(spark, sf).filter("good AND radius > 0").drop("good"))
    return s.select("source_id", "radius", "matched", out(C("pixel_count") / C("footprint_area")).alias("fill"))
