"""Queries of scans and sinks: tables go through files in the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.registry import query
from lumenfold.plans.tables import detections, read, refit, sfin, sources, weights, with_tables
from lumenfold.session import shared_dir
from lumenfold.sources import catalogs as K

C = F.col


def place(spark) -> str:
    """A folder of this query's own; the files go with the session's other tables."""
    path = f"{shared_dir(spark)}/lumenfold/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def csv(df: DataFrame) -> str:
    path = place(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path


@query("scan_catalog", with_tables("sources", "SELECT source_id, patch, band, x, y FROM sources WHERE band <> 'view'"))
def scan_catalog(spark, sf):
    path = place(spark)
    K.sink_classed_catalog(sources(spark, sf).select("source_id", "patch", "band", "x", "y"), path)
    return K.scan_catalog(spark, path).filter("band <> 'view'").select("source_id", C("patch").cast("long").alias("patch"), "band", "x", "y")


@query("sink_classed_catalog", with_tables("sources", "SELECT source_class, band, source_id FROM (SELECT *, CASE WHEN area > 900 THEN 'rejected' WHEN f_bad THEN 'ignore' ELSE 'clean' END AS source_class FROM sources) WHERE source_class <> 'ignore'"))
def sink_classed_catalog(spark, sf):
    path = place(spark)
    cls = F.when(C("area") > 900, "rejected").when(C("f_bad"), "ignore").otherwise("clean")
    K.sink_classed_catalog(sources(spark, sf).select("source_id", "patch", "band", cls.alias("source_class")), path)
    return K.scan_catalog(spark, path).filter("source_class <> 'ignore'").select("source_class", "band", "source_id")


@query("scan_pixel_planes", with_tables("pixels", "SELECT band, x + 100 AS x, y + 50 AS y, round(image, 6) AS image, mask FROM pixels WHERE flag = 'A'"))
def scan_pixel_planes(spark, sf):
    from lumenfold.plans.tables import pixels

    path = place(spark)
    p = pixels(spark, sf).select("patch", "band", "flag", "x", "y", "image", "mask", "variance", F.lit(100).alias("x_origin"), F.lit(50).alias("y_origin"))
    K.sink_pixel_planes(p, path)
    return K.scan_pixel_planes(spark, path).filter("flag = 'A'").select("band", "x", "y", F.round("image", 6).alias("image"), "mask")


@query("scan_nuclei_rows", "SELECT (user_id % 5)::INT AS frame, event_id::INT AS cell, round(value, 2) AS x, round(value * 2, 2) AS y, 3.5::DOUBLE AS z, (event_id % 40)::DOUBLE / 2 AS radius FROM events WHERE event_id % 6 > 0")
def scan_nuclei_rows(spark, sf):
    path = place(spark)
    e = read(spark, sf, "events").withColumn("frame", C("user_id") % 5)
    line = F.concat_ws(", ", C("event_id").cast("string"), *[F.lit(str(k)) for k in range(4)], F.round("value", 2).cast("string"), F.round(C("value") * 2, 2).cast("string"), F.lit("3.5"), (C("event_id") % 40).cast("string"), F.lit("n"), F.lit("0"))
    short = F.when(C("event_id") % 6 == 0, F.substring_index(line, ",", 9)).otherwise(line)
    e.select(short.alias("value"), F.concat(F.lit("t00"), (C("frame") + 1).cast("string"), F.lit("-nuclei")).alias("file")).write.partitionBy("file").text(path)
    return K.scan_nuclei_rows(spark, path, r"t(\d+)-nuclei")


@query("discover_samples", with_tables("samples", "SELECT source, band, patch, grp::VARCHAR AS grp, num_samples::INT AS num_samples FROM samples WHERE sample_id % 3 > 0 AND sample_id % 5 > 0 AND source IN ('Brand#11', 'Brand#12', 'Brand#13') AND band <> 'SMALL'"))
def discover_samples(spark, sf):
    from lumenfold.plans.tables import samples

    path = place(spark)
    s = samples(spark, sf)
    bands = F.when(C("sample_id") % 5 == 0, F.array("band", F.lit("other"))).otherwise(F.array("band"))
    s.select("source", bands.alias("bands"), "patch", C("grp").cast("string").alias("grp"), "num_samples", (C("sample_id") % 3 > 0).alias("finished")).write.json(path)
    wanted = [r[0] for r in s.filter("band <> 'SMALL'").select("band").distinct().collect()]
    return K.discover_samples(spark, path, ["Brand#11", "Brand#12", "Brand#13"], wanted, multiline=False).select("source", "band", "patch", "grp", "num_samples")


@query("scan_detections_csv", with_tables("sources detections", "SELECT det_id AS id, x, y, score FROM detections WHERE det_id % 13 <> 0"))
def scan_detections_csv(spark, sf):
    d = detections(spark, sf)
    path = csv(d.select(C("det_id").alias("id"), F.when(C("det_id") % 13 == 0, "none").otherwise(C("x").cast("string")).alias("x_image"), "y", "score"))
    return K.scan_detections_csv(spark, path).select("id", "x", "y", "score")


@query("scan_refit_csv", with_tables("refit", "SELECT source_id, radius, pixel_count FROM (SELECT source_id % 5000 AS source_id, radius, pixel_count, row_number() OVER (PARTITION BY source_id % 5000 ORDER BY source_id DESC) AS n FROM refit WHERE good AND radius > 0) WHERE n = 1"))
def scan_refit_csv(spark, sf):
    r = refit(spark, sf).selectExpr("source_id % 5000 AS source_id", "source_id AS row_index", "CAST(good AS STRING) AS proxy_nan0_good", "radius AS proxy_nan0_flux_aperture_radius", "pixel_count AS aperture_pixel_count")
    return K.scan_refit_csv(spark, csv(r))


@query("scan_weights", with_tables("weights", f"SELECT grp, round(sum(weight), 4) AS total, count(*) AS n FROM weights WHERE valid AND collection = 'A' AND {sfin('weight')} AND weight > 0 GROUP BY grp"))
def scan_weights(spark, sf):
    from lumenfold.operators.summaries import weight_summary

    w = weights(spark, sf).selectExpr("concat(' ', collection, ' ') AS product_collection", "grp AS group_num", "weight", "CAST(valid AS STRING) AS has_valid_hsctile_weight")
    return weight_summary(K.scan_weights(spark, csv(w), "a", True), ["grp"]).select("grp", F.round("total", 4).alias("total"), "n")


@query("scan_group_meta_json", with_tables("weights", f"SELECT grp AS group_index, round(sum(weight), 4) AS total, count(*) AS n, min(weight) AS low, max(weight) AS high FROM weights WHERE {sfin('weight')} AND weight > 0 GROUP BY grp"))
def scan_group_meta_json(spark, sf):
    path = place(spark)
    chunks = weights(spark, sf).filter("NOT isnan(weight)").groupBy("grp", F.pmod(F.xxhash64("weight", "collection"), F.lit(50)).alias("k")).agg(F.collect_list("weight").alias("selected_weights"))
    chunks.select(C("grp").alias("group_index"), "selected_weights").write.json(path)
    return K.scan_group_meta_json(spark, path, multiline=False).withColumn("total", F.round("total", 4))


@query("scan_tracks_tsv", "SELECT event_type AS sequence, event_id::INT AS cell_id, (user_id % 30)::INT AS t, value * 2 AS diameter FROM events")
def scan_tracks_tsv(spark, sf):
    e = read(spark, sf, "events")
    out = None
    for kind in ("click", "error", "purchase", "signup", "view"):
        path = place(spark)
        e.filter(C("event_type") == kind).selectExpr("user_id % 30 AS t", "1 AS z", "2 AS y", "3 AS x", "event_id AS cell_id", "-1 AS parent_id", "user_id AS track_id", "value AS radius", "'n' AS name", "0 AS div_state").write.option("header", True).option("sep", "\t").csv(path)
        one = K.scan_tracks_tsv(spark, path, kind).select("sequence", "cell_id", "t", "diameter")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_quality_csv", with_tables("sources", f"SELECT source_id, CASE WHEN {sfin('flux')} THEN flux END AS flux, area FROM sources"))
def sink_quality_csv(spark, sf):
    path = place(spark)
    K.sink_quality_csv(sources(spark, sf).select("source_id", "flux", "area"), path)
    return spark.read.option("header", True).csv(path).select(K.number("source_id", "long").alias("source_id"), K.number("flux").alias("flux"), K.number("area").alias("area"))


@query("sink_region_text", with_tables("sources", "SELECT band AS source_class, CASE WHEN a * b * 3.141592653589793::DOUBLE <= 100 THEN printf('image;ellipse(%.3f,%.3f,%.3f,%.3f,', x + 1, y + 1, a, b) ELSE printf('image;point(%.3f,%.3f) # point=x color=yellow', x + 1, y + 1) END AS line FROM sources"))
def sink_region_text(spark, sf):
    path = place(spark)
    K.sink_region_text(sources(spark, sf).withColumn("source_class", C("band")), path, large_as_point=100.0)
    # The angle's last digit is left out: it hangs on the rounding of degrees.
    return spark.read.text(path).select("source_class", F.regexp_replace("value", r"(ellipse\([^)]*,)[^,)]*\).*$", "$1").alias("line"))


@query("sink_failures", with_tables("sources", "SELECT source_id FROM sources WHERE f_bad"))
def sink_failures(spark, sf):
    path = place(spark)
    s = sources(spark, sf).select("source_id", F.when(C("f_bad"), "bad").alias("error"))
    K.sink_failures(s, path)
    return spark.read.parquet(path).select("source_id")


@query("incremental_worklist", with_tables("sources refit", "SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM refit WHERE good)"))
def incremental_worklist(spark, sf):
    done = refit(spark, sf).select("source_id", F.when(~C("good"), "failed").alias("error"))
    return K.incremental_worklist(sources(spark, sf).select("source_id"), done, ["source_id"])
