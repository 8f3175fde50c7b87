"""Engine tables made from the given tables by plain arithmetic, as DataFrames and as SQL.

Each ``*_SQL`` text is a list of common table expressions without WITH; :func:`with_tables` puts
them before a statement. Both sides use integers first and divide last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.expr import finite


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out(c: str | Column, digits: int = 6) -> Column:
    """A double for results: rounded, and NULL where it is not finite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), F.round(c, digits))


def sout(text: str, digits: int = 6) -> str:
    """The SQL of :func:`out`."""
    return f"CASE WHEN {sfin(text)} THEN round({text}, {digits}) END"


def sfin(text: str) -> str:
    """The SQL of finite()."""
    return f"(({text}) IS NOT NULL AND NOT isnan({text}) AND NOT isinf({text}))"


def smag(text: str, zero_point: float = 27.0) -> str:
    """The SQL of flux_to_mag()."""
    return f"(CASE WHEN {sfin(text)} AND ({text}) > 0 THEN {zero_point}::DOUBLE - 2.5::DOUBLE * log10({text}) ELSE 'NaN'::DOUBLE END)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured source an event, patches of 16,384 side by side; a few fluxes are NaN, NULL or negative."""
    e = read(spark, sf_dir, "events")
    x = lambda t: F.expr(t)
    e = e.withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return e.select(
        x("event_id AS source_id"), x("event_type AS band"), x("user_id"), x("c"), x("ts"),
        x("CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id - event_id % 4 END AS parent"),
        x("CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS n_child"),
        x("event_id div 16384 AS patch"), x("CAST((c * 7919 + event_id * 31) % 1024 + event_id div 16384 * 2048 AS DOUBLE) AS x"), x("CAST((event_id * 104729 + user_id * 613) % 1021 AS DOUBLE) AS y"),
        x("CASE WHEN event_id % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 107 = 0 THEN -value ELSE value END AS flux"),
        x("CAST(event_id % 13 AS DOUBLE) / 4D + 0.5D AS flux_err"),
        x("value * (CAST(event_id % 7 AS DOUBLE) / 4D + 0.5D) AS ap_flux"), x("value * (CAST(event_id % 5 AS DOUBLE) / 8D + 0.75D) AS kron_flux"),
        x("CAST(event_id % 9 + 2 AS DOUBLE) AS a"), x("CAST(event_id % 5 + 1 AS DOUBLE) AS b"), x("CAST(event_id % 31 AS DOUBLE) / 10D AS theta"),
        x("CAST(event_id % 17 AS DOUBLE) / 2D AS xx"), x("CAST(event_id % 11 AS DOUBLE) / 2D AS yy"), x("CAST(event_id % 7 - 3 AS DOUBLE) / 4D AS xy"),
        x("CAST(c % 1500 + 20 AS DOUBLE) AS area"), x("CAST(c % 97 AS DOUBLE) / 96D * CAST(c % 1500 + 20 AS DOUBLE) AS pixels_in"),
        x("event_id % 11 = 0 AS f_edge"), x("event_id % 13 = 0 AS f_sat"), x("event_id % 17 = 0 AS f_bad"), x("event_id % 19 <> 0 AS detect_isPrimary"), x("event_id % 23 = 0 AS f_bright"),
        x("CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) / 2D END AS extendedness"), x("event_id % 64 AS mask"),
    )


SOURCES_SQL = """
sources AS (SELECT event_id AS source_id, event_type AS band, user_id, c, ts,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id - event_id % 4 END AS parent,
  CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS n_child,
  event_id // 16384 AS patch, ((c * 7919 + event_id * 31) % 1024 + event_id // 16384 * 2048)::DOUBLE AS x, ((event_id * 104729 + user_id * 613) % 1021)::DOUBLE AS y,
  CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 107 = 0 THEN -value ELSE value END AS flux,
  (event_id % 13)::DOUBLE / 4::DOUBLE + 0.5::DOUBLE AS flux_err,
  value * ((event_id % 7)::DOUBLE / 4::DOUBLE + 0.5::DOUBLE) AS ap_flux, value * ((event_id % 5)::DOUBLE / 8::DOUBLE + 0.75::DOUBLE) AS kron_flux,
  (event_id % 9 + 2)::DOUBLE AS a, (event_id % 5 + 1)::DOUBLE AS b, (event_id % 31)::DOUBLE / 10::DOUBLE AS theta,
  (event_id % 17)::DOUBLE / 2::DOUBLE AS xx, (event_id % 11)::DOUBLE / 2::DOUBLE AS yy, (event_id % 7 - 3)::DOUBLE / 4::DOUBLE AS xy,
  (c % 1500 + 20)::DOUBLE AS area, (c % 97)::DOUBLE / 96::DOUBLE * (c % 1500 + 20)::DOUBLE AS pixels_in,
  event_id % 11 = 0 AS f_edge, event_id % 13 = 0 AS f_sat, event_id % 17 = 0 AS f_bad, event_id % 19 <> 0 AS detect_isPrimary, event_id % 23 = 0 AS f_bright,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 3)::DOUBLE / 2::DOUBLE END AS extendedness, event_id % 64 AS mask
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the sources, moved by up to 1.5 pixels."""
    s = sources(spark, sf_dir).filter("source_id % 10 <> 0")
    return s.selectExpr("source_id AS det_id", "band", "x + CAST(source_id % 5 - 2 AS DOUBLE) * 0.75D AS x", "y + CAST(source_id % 3 - 1 AS DOUBLE) * 0.75D AS y", "c / 100D AS score", "ap_flux")


DETECTIONS_SQL = """
detections AS (SELECT source_id AS det_id, band, x + (source_id % 5 - 2)::DOUBLE * 0.75::DOUBLE AS x, y + (source_id % 3 - 1)::DOUBLE * 0.75::DOUBLE AS y, c / 100::DOUBLE AS score, ap_flux
  FROM sources WHERE source_id % 10 <> 0)"""


def refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refit row an order: radius, pixel count, area, and whether it is good."""
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS source_id", "CAST(o_orderkey % 40 AS DOUBLE) / 4D AS radius", "CAST(o_orderkey % 700 AS DOUBLE) AS pixel_count", "CAST(o_orderkey % 900 + 1 AS DOUBLE) AS footprint_area", "o_orderstatus <> 'P' AS good", "o_custkey AS file_order")


REFIT_SQL = """
refit AS (SELECT o_orderkey AS source_id, (o_orderkey % 40)::DOUBLE / 4::DOUBLE AS radius, (o_orderkey % 700)::DOUBLE AS pixel_count, (o_orderkey % 900 + 1)::DOUBLE AS footprint_area, o_orderstatus <> 'P' AS good, o_custkey AS file_order FROM orders)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exposure weight a line item."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_linenumber AS grp", "l_returnflag AS collection", "CASE WHEN l_partkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_partkey % 51 = 0 THEN 0D ELSE l_quantity END AS weight", "l_linestatus = 'O' AS valid")


WEIGHTS_SQL = """
weights AS (SELECT l_linenumber AS grp, l_returnflag AS collection, CASE WHEN l_partkey % 50 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 51 = 0 THEN 0::DOUBLE ELSE l_quantity END AS weight, l_linestatus = 'O' AS valid FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample store a part."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS sample_id", "p_brand AS source", "CAST(p_size AS STRING) AS patch", "p_type AS band", "p_partkey % 4 AS grp", "p_partkey % 90 + 1 AS num_samples", "CAST((p_partkey * 37) % 5000 AS DOUBLE) AS bx", "CAST((p_partkey * 91) % 5000 AS DOUBLE) AS by")


SAMPLES_SQL = """
samples AS (SELECT p_partkey AS sample_id, p_brand AS source, p_size::VARCHAR AS patch, p_type AS band, p_partkey % 4 AS grp, p_partkey % 90 + 1 AS num_samples, ((p_partkey * 37) % 5000)::DOUBLE AS bx, ((p_partkey * 91) % 5000)::DOUBLE AS by FROM part)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel plane a return flag and 32,768 orders: mean price as image, line numbers as mask bits.

    ``band`` names a plane, and ``cell`` a pixel among all planes.
    """
    p = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "l_orderkey div 32768 AS patch", "CAST(l_partkey % 64 AS INT) AS x", "CAST(l_suppkey % 64 AS INT) AS y", "CAST(round(l_extendedprice * 100) AS BIGINT) AS p", "l_linenumber % 8 AS m")
    g = p.groupBy("flag", "patch", "x", "y").agg((F.sum("p") / F.count("*") / 100.0).alias("image"), F.pmod(F.sum("m"), F.lit(8)).cast("long").alias("mask"), F.count("*").alias("n"))
    code = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    return g.withColumns({"variance": 1.0 + F.col("n") / 4.0, "band": F.concat("flag", F.col("patch").cast("string")), "cell": (F.col("patch") * 4 + code) * 4096 + F.col("x") * 64 + F.col("y")})


PIXELS_SQL = """
pixels AS (SELECT *, 1.0::DOUBLE + n / 4.0::DOUBLE AS variance, flag || patch AS band, (patch * 4 + CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 4096 + x * 64 + y AS cell FROM (SELECT l_returnflag AS flag, l_orderkey // 32768 AS patch, (l_partkey % 64)::INT AS x, (l_suppkey % 64)::INT AS y,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*) / 100.0::DOUBLE AS image, (sum(l_linenumber % 8) % 8)::BIGINT AS mask, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4))"""

_ALL = {"sources": SOURCES_SQL, "detections": DETECTIONS_SQL, "refit": REFIT_SQL, "weights": WEIGHTS_SQL, "samples": SAMPLES_SQL, "pixels": PIXELS_SQL}


def with_tables(names: str, statement: str, *more: str) -> str:
    """WITH the named tables and further expressions, then a statement."""
    return "WITH RECURSIVE " + ",".join([_ALL[n] for n in names.split()] + list(more)) + "\n" + statement
