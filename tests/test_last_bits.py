"""Rows of larger tables on which a query once differed from its SQL."""

import datetime

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenfold.plans import registry


def events(folder, rows: list[tuple[int, int, str, float]]) -> str:
    """A folder whose events (event_id, user_id, event_type, value) are ``rows``."""
    ids, users, kinds, values = zip(*rows, strict=True)
    ts = pa.array([datetime.datetime(2024, 1, 1)] * len(rows), pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": ts, "user_id": pa.array(users, pa.int64()), "event_type": kinds, "value": values, "props": ["{}"] * len(rows)}), folder / "events.parquet")
    return str(folder)


def same(spark, name: str, sf_dir: str) -> None:
    assert oracle.difference(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("ids", [(114384, 419889), (159024, 375249)])
def test_points_on_a_rim_follow_the_last_bit_of_the_sine(spark, tmp_path, ids):
    same(spark, "ellipse_contains", events(tmp_path, [(i, 7, "view", 12.5) for i in ids]))


def test_ratios_of_fluxes_count_rows_without_light(spark, tmp_path):
    rows = [(i, 7, "view" if i < 30 else "click", 0.0 if i == 4 else 10.0 + i) for i in range(1, 60)] + [(60, 8, "error", -0.0), (61, 8, "error", -2.0)]
    same(spark, "flux_ratio_stats", events(tmp_path, rows))


def test_coverage_follows_the_last_bit_of_the_sine(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators import joins as J

    row = spark.range(2).select(F.col("id").alias("source_id"), F.lit("v").alias("band"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(3.0).alias("a"), F.lit(2.0).alias("b"), F.lit(2.5).alias("theta"), F.lit(1.0).alias("area"))
    # The sine of 2.5, rightly rounded; the JVM's is one unit less.
    assert J.ellipse_pairs(row, ["band"]).select("s.sin").first()[0] == float.fromhex("0x1.326af0dcfcab1p-1")


def test_measures_of_pairs_are_not_made_point_by_point(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators import joins as J

    row = spark.range(2).select(F.col("id").alias("source_id"), F.lit("v").alias("band"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(3.0).alias("a"), F.lit(2.0).alias("b"), F.lit(2.5).alias("theta"), F.lit(1.0).alias("area"))
    pairs = J.ellipse_pairs(row, ["band"])
    for made in (J.ellipse_overlap_join(row, None, ["band"]), pairs.select(J.pixel_iou(F.col("s"), F.col("t")))):
        assert "ArrowEvalPython" in made._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
        assert len(made.collect()) == 1


def test_points_and_regions_are_not_broadcast_by_the_size_of_a_file(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators import joins as J
    from lumenfold.operators import objects as O

    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    points = spark.range(4).select(F.col("id"), F.lit("v").alias("band"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert "Broadcast" not in plan(J.pairs_within(points, points, 1.0, ["band"]))
    runs = spark.range(4).select(F.lit("v").alias("band"), F.col("id").alias("region"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x0"), F.lit(2).alias("x1"))
    found = O.component_of(points.selectExpr("band", "CAST(x AS INT) AS px", "CAST(id AS INT) AS py"), runs, ["band"])
    assert "Broadcast" not in plan(found)
    assert sorted(r["region"] for r in found.select("region").collect() if r["region"] is not None) == [0, 1, 2]
