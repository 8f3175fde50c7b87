"""Scans and sinks of catalogs, detections, weights, tracks, nuclei and sample stores.

Scans take a schema, read by column, and turn what cannot be parsed into NULL. Sinks write
partitioned tables; text sinks are projections of one string column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.expr import finite
from lumenfold.operators.joins import last_by

PARTITIONS = ["tract", "patch", "band"]


def number(c: str | Column, kind: str = "double") -> Column:
    """A text as a number; NULL where it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(kind)


def scan_catalog(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All measured-source tables below ``path``, which is laid out by tract, patch and band."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_detections_csv(spark: SparkSession, path: str, optional: tuple[str, ...] = ("score", "major", "minor", "theta")) -> DataFrame:
    """(id, x, y, optional numbers): rows with a finite centre.

    x_image and y_image stand in for x and y where the header lacks these.
    """
    df = spark.read.option("header", True).csv(path)
    pick = lambda c: number(c if c in df.columns else f"{c}_image")
    out = df.select(number("id", "long").alias("id") if "id" in df.columns else F.lit(None).cast("long").alias("id"), pick("x").alias("x"), pick("y").alias("y"), *[number(c).alias(c) for c in optional if c in df.columns])
    return out.filter(finite("x") & finite("y"))


def scan_refit_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, radius, pixel_count): good rows with a finite positive radius, the last by row_index of each id."""
    df = spark.read.option("header", True).csv(path)
    good = F.lower(F.trim("proxy_nan0_good")).isin("true", "1", "yes")
    rows = df.filter(good).select(number("source_id", "long").alias("source_id"), number("row_index", "long").alias("row_index"), number("proxy_nan0_flux_aperture_radius").alias("radius"), number("aperture_pixel_count").alias("pixel_count"))
    return last_by(rows.filter(finite("radius") & (F.col("radius") > 0) & F.col("source_id").isNotNull()), "source_id", "row_index").drop("row_index")


def scan_weights(spark: SparkSession, path: str, collection: str | None = None, valid_only: bool = False) -> DataFrame:
    """(collection, grp, weight) of exposure weights, by lower-cased trimmed collection."""
    df = spark.read.option("header", True).csv(path)
    rows = df.select(F.lower(F.trim("product_collection")).alias("collection"), number("group_num", "int").alias("grp"), number("weight").alias("weight"), F.lower(F.trim("has_valid_hsctile_weight")).isin("true", "1", "yes").alias("valid"))
    if collection is not None:
        rows = rows.filter(F.col("collection") == collection.strip().lower())
    return (rows.filter("valid") if valid_only else rows).drop("valid")


def scan_group_meta_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(group_index, total, n, low, high) of the selected weights in group descriptions: one a file, or one a line."""
    df = spark.read.schema("group_index INT, selected_weights ARRAY<DOUBLE>").option("multiLine", multiline).json(path)
    w = df.select("group_index", F.explode("selected_weights").alias("w")).filter(finite("w") & (F.col("w") > 0))
    return w.groupBy("group_index").agg(F.sum("w").alias("total"), F.count("*").alias("n"), F.min("w").alias("low"), F.max("w").alias("high"))


def scan_tracks_tsv(spark: SparkSession, path: str, sequence: str) -> DataFrame:
    """(sequence, t, x, y, z, cell_id, parent_id, track_id, diameter) of track annotations."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    ints = [number(c, "int").alias(c) for c in ("t", "cell_id", "parent_id", "track_id")]
    return df.select(F.lit(sequence).alias("sequence"), *ints, *[number(c).alias(c) for c in ("x", "y", "z")], (2 * number("radius")).alias("diameter")).filter("t is not null")


def scan_nuclei_rows(spark: SparkSession, path: str, number_of: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """(frame, cell, x, y, z, radius) of headless nuclei files, by position; the frame is the number in the file's path less one.

    ``number_of``: a pattern whose first group is that number. Rows of fewer than eleven columns are dropped.
    """
    parts = F.split("value", r"\s*,\s*")
    df = spark.read.text(path).select("value", (F.regexp_extract(F.input_file_name(), number_of, 1).try_cast("int") - 1).alias("frame"))
    at = lambda i: number(parts[i])
    return df.filter(F.size(parts) >= 11).select("frame", number(parts[0], "int").alias("cell"), at(5).alias("x"), at(6).alias("y"), at(7).alias("z"), (at(8) / 2).alias("radius"))


#: Columns of a pixel plane's table; further ones stay.
PIXEL_COLUMNS = {"x": "int", "y": "int", "image": "double", "mask": "long", "variance": "double"}


def sink_pixel_planes(df: DataFrame, path: str, mode: str = "overwrite", cell: int = 256) -> None:
    """One folder a tract, patch and band, in the order of grid cells, so that a cut-out reads few row groups."""
    keys = [c for c in PARTITIONS if c in df.columns]
    at = [F.floor(F.col(c) / cell) for c in ("y", "x")]
    df.repartition(*keys, *at).sortWithinPartitions(*keys, *at, "y", "x").write.mode(mode).partitionBy(*keys).parquet(path)


def scan_pixel_planes(spark: SparkSession, path: str) -> DataFrame:
    """Pixel planes as one long table (tract, patch, band, x, y, image, mask, variance) in sky pixels.

    ``x_origin`` and ``y_origin``, where a table has them, are the sky position of its plane's first pixel.
    """
    df = spark.read.parquet(path)
    missing = [c for c in PIXEL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"a pixel plane needs {', '.join(missing)}")
    out = df.withColumns({c: F.col(c).cast(t) for c, t in PIXEL_COLUMNS.items()})
    for c in ("x", "y"):
        if f"{c}_origin" in df.columns:
            out = out.withColumn(c, (F.col(c) + F.col(f"{c}_origin")).cast("int"))
    return out.drop("x_origin", "y_origin")


def discover_samples(spark: SparkSession, path: str, sources: list[str], bands: list[str], multiline: bool = True) -> DataFrame:
    """Metadata rows of finished single-band sample stores of the wanted sources and bands: one a file, or one a line.

    Sources agree whatever their case; an empty list wants all.
    """
    schema = "source STRING, bands ARRAY<STRING>, patch STRING, grp STRING, num_samples INT, finished BOOLEAN"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multiline).json(path)
    one = df.filter(F.coalesce("finished", F.lit(False)) & (F.size("bands") == 1)).withColumn("band", F.col("bands")[0])
    wanted = F.lower("source").isin([s.lower() for s in sources]) if sources else F.lit(True)
    return one.filter(wanted & (F.col("band").isin(bands) if bands else F.lit(True))).drop("bands", "finished")


def sink_classed_catalog(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a tract, patch, band and class; rows of a class come from as many tasks as hold them."""
    df.write.mode(mode).partitionBy(*[c for c in [*PARTITIONS, "source_class"] if c in df.columns]).parquet(path)


def sink_quality_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV with a header in which numbers that were not measured are empty."""
    clean = [F.when(finite(n), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    df.select(*clean).write.mode(mode).option("header", True).csv(path)


def region_lines(df: DataFrame, color: str = "green", point_color: str = "yellow", large_as_point: float = 1e4) -> DataFrame:
    """DS9 lines, in pixels counted from 1: an ellipse, or a point where the ellipse is too large or not known."""
    ellipse = finite("a") & finite("b") & finite("theta") & (F.col("a") * F.col("b") * 3.141592653589793 <= large_as_point)
    x, y = F.col("x") + 1, F.col("y") + 1
    line = F.when(ellipse, F.format_string(f"image;ellipse(%.3f,%.3f,%.3f,%.3f,%.3f) # color={color}", x, y, F.col("a"), F.col("b"), F.degrees("theta"))).otherwise(F.format_string(f"image;point(%.3f,%.3f) # point=x color={point_color}", x, y))
    return df.filter(finite("x") & finite("y")).select("source_id", *[c for c in ("source_class",) if c in df.columns], line.alias("value"))


def sink_region_text(df: DataFrame, path: str, mode: str = "overwrite", large_as_point: float = 1e4) -> None:
    """Region lines as text, below one folder a class where there is one."""
    lines = region_lines(df, large_as_point=large_as_point).drop("source_id")
    writer = lines.write.mode(mode)
    (writer.partitionBy("source_class") if "source_class" in lines.columns else writer).text(path)


def sink_failures(df: DataFrame, path: str) -> None:
    """Append the units that failed: rows with an error."""
    df.filter("error is not null").write.mode("append").parquet(path)


def incremental_worklist(work: DataFrame, done: DataFrame, key: list[str], failed_only: bool = False) -> DataFrame:
    """Units of work without an output yet; with ``failed_only`` those whose last output is an error."""
    if failed_only:
        return work.join(done.filter("error is not null").select(*key).distinct(), key, "left_semi")
    return work.join(done.filter("error is null").select(*key).distinct(), key, "left_anti")
