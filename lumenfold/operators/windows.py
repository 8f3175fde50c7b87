"""Window operators, selections of groups, and operators built from matchings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import joins as J


def frame_at_rank(frames: DataFrame, rank: int) -> DataFrame:
    """Per tile the frame at ``rank`` by (ts, event_id): from the end if negative, clamped to what there is."""
    order = Window.partitionBy("tile").orderBy("ts", "event_id")
    n = F.count("*").over(Window.partitionBy("tile"))
    at = F.lit(rank + 1) if rank >= 0 else n + rank + 1
    ranked = frames.withColumns({"__r": F.row_number().over(order), "__at": F.greatest(F.least(at, n), F.lit(1))})
    return ranked.filter("__r = __at").drop("__r", "__at")


def frame_of_visit(frames: DataFrame, visit: str) -> DataFrame:
    """Per tile the first frame of a visit."""
    rank = F.row_number().over(Window.partitionBy("tile").orderBy("ts", "event_id"))
    return frames.filter(F.col("visit") == visit).withColumn("__r", rank).filter("__r = 1").drop("__r")


def track_length(rows: DataFrame, track: str, frame: str) -> DataFrame:
    """``rows`` with frames, the number of distinct frames of their track."""
    n = rows.groupBy(track).agg(F.countDistinct(frame).alias("frames"))
    return rows.join(n, track)


def stars_near_clusters(members: DataFrame, stars: DataFrame, inner: float, outer: float, by: list[str]) -> DataFrame:
    """(by, star_id, cluster, mode, d): stars within ``inner`` of a member, else within ``outer`` of a cluster's centroid.

    ``members``: by, cluster, x, y; ``stars``: by, star_id, x, y. ``d`` is the distance that decides: to the
    nearest member (source_center), or to the mean of the members (cluster_centroid).
    """
    near = J.pairs_within(stars, members, inner, by, "star_id", "cluster").select(*by, "a", "b", F.struct(F.lit(0).alias("k"), "d").alias("m"))
    centroids = members.groupBy(*by, "cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    far = J.pairs_within(stars, centroids, outer, by, "star_id", "cluster").select(*by, "a", "b", F.struct(F.lit(1).alias("k"), "d").alias("m"))
    best = near.unionByName(far).groupBy(*by, F.col("a").alias("star_id"), F.col("b").alias("cluster")).agg(F.min("m").alias("m"))
    return best.select(*by, "star_id", "cluster", F.when(F.col("m.k") == 0, "source_center").otherwise("cluster_centroid").alias("mode"), F.col("m.d").alias("d"))


def assign_stars(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of a star's candidate clusters the nearest, ties by the lesser cluster; a cluster may have several stars.

    Stars compete for no cluster, so that their magnitudes order the stars of a cluster alone.
    """
    best = candidates.groupBy(*by, "star_id").agg(F.min(F.struct("d", "cluster", "mode")).alias("m"))
    return best.select(*by, "star_id", "m.cluster", "m.mode", "m.d")


def selector_expand(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sample_id, alias): the samples that each wanted selector names, by any of their aliases."""
    place = F.concat_ws(":", "source", "patch")
    aliases = F.array(place, F.concat_ws("@", place, F.col("grp").cast("string")), F.concat(F.col("source"), F.lit(":*")))
    return samples.select("sample_id", F.explode(aliases).alias("alias")).join(wanted.select("alias").distinct(), "alias", "left_semi").select("sample_id", "alias").distinct()


def random_group(samples: DataFrame, seed: int) -> DataFrame:
    """One group of each source and patch: the least by SHA-256 of seed and names."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "source", "patch", F.col("grp").cast("string")), 256)
    groups = samples.select("source", "patch", "grp").distinct()
    return groups.groupBy("source", "patch").agg(F.min_by("grp", key).alias("grp"))


def split_guard(train: DataFrame, validation: DataFrame, size: float, pad: float) -> DataFrame:
    """Training samples that share no sky with validation: neither a source and patch, nor padded boxes of one source."""
    kept = train.join(validation.select("source", "patch").distinct(), ["source", "patch"], "left_anti")
    reach = size + 2 * pad
    boxes = lambda df, p: df.select("source", F.col("sample_id").alias(f"{p}_id"), F.col("bx").alias(f"{p}x"), F.col("by").alias(f"{p}y"))
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.struct((cell("vx") + i).alias("cx"), (cell("vy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = boxes(validation, "v").withColumn("c", F.explode(around)).select("source", "vx", "vy", "c.cx", "c.cy")
    near = boxes(kept, "t").withColumns({"cx": cell("tx"), "cy": cell("ty")}).join(spread, ["source", "cx", "cy"])
    hit = near.filter((F.abs(F.col("tx") - F.col("vx")) < reach) & (F.abs(F.col("ty") - F.col("vy")) < reach)).select(F.col("t_id").alias("sample_id")).distinct()
    return kept.join(hit, "sample_id", "left_anti")


def strict_point_metrics(points: DataFrame, base: DataFrame, strict: DataFrame, radius: float, by: str, id_col: str, target_id: str) -> DataFrame:
    """Per group: targets, predictions and matches against the base set, and against it with the strict one.

    Targets with repeated coordinates count once; ratios are NULL where there is nothing to divide by.
    """
    out = None
    one = base.select(by, target_id, "x", "y")
    sets = {"base": one, "combined": one.unionByName(strict.select(by, target_id, "x", "y"))}
    for name, targets in sets.items():
        unique = targets.groupBy(by, "x", "y").agg(F.min(target_id).alias(target_id))
        tp = J.greedy_match(J.pairs_within(points, unique, radius, [by], id_col, target_id), [by]).groupBy(by).agg(F.count("*").alias("tp"))
        counts = unique.groupBy(by).agg(F.count("*").alias("targets")).join(points.groupBy(by).agg(F.count("*").alias("predictions")), by, "full").join(tp, by, "left").na.fill(0)
        row = counts.select(by, F.lit(name).alias("subset"), "targets", "predictions", "tp", F.when(F.col("targets") > 0, F.col("tp") / F.col("targets")).alias("completeness"), F.when(F.col("predictions") > 0, F.col("tp") / F.col("predictions")).alias("purity"))
        out = row if out is None else out.unionByName(row)
    return out


def visit_difference(a: DataFrame, b: DataFrame, radius: float, by: list[str], id_col: str, planes: tuple[DataFrame, DataFrame] | None = None, apertures: tuple[float, float, float] = (5.0, 7.0, 12.0), least: int = 16, least_annulus: int = 1) -> DataFrame:
    """(by, a, b, kind): detections common to two visits, and those in one alone.

    With the pixel ``planes`` of both visits (by, x, y, image, excluded) also snr_a, trusted_a, snr_b and
    trusted_b of the detections in one visit alone, measured at their place in either visit.
    """
    m = J.mutual_nearest_match(a, b, radius, by, id_col, id_col).select(*by, "a", "b")
    only = lambda df, side: df.select(*by, F.col(id_col).alias(side), "x", "y").join(m.select(*by, side), [*by, side], "left_anti")
    none = F.lit(None).cast("long")
    left, right = only(a, "a").withColumns({"b": none, "kind": F.lit("only_a")}), only(b, "b").withColumns({"a": none, "kind": F.lit("only_b")})
    cols = [*by, "a", "b", "kind"]
    alone = left.select(*cols, "x", "y").unionByName(right.select(*cols, "x", "y"))
    if planes is None:
        return m.withColumn("kind", F.lit("common")).select(*cols).unionByName(alone.select(*cols))
    from lumenfold.operators.objects import ap2_snr_measure

    key = F.struct(F.col("kind").alias("kind"), F.coalesce("a", "b").alias("id"))
    centers = alone.select(*by, key.alias("id"), F.floor(F.col("x") + 0.5).cast("int").alias("px"), F.floor(F.col("y") + 0.5).cast("int").alias("py"))
    out = alone.withColumn("id", key)
    for side, plane in zip("ab", planes, strict=True):
        found = ap2_snr_measure(centers, plane, *apertures, by, least, least_annulus)
        out = out.join(found.select(*by, "id", F.col("snr").alias(f"snr_{side}"), F.col("trusted").alias(f"trusted_{side}")), [*by, "id"], "left")
    measured = ["snr_a", "trusted_a", "snr_b", "trusted_b"]
    return m.withColumn("kind", F.lit("common")).select(*cols).unionByName(out.select(*cols, *measured), allowMissingColumns=True)


def disk_samples(ellipses: DataFrame, n: int) -> DataFrame:
    """``ellipses`` (x, y, a, b, theta) with k, px, py: n points spread over each by the golden angle."""
    turn = math.pi * (3.0 - math.sqrt(5.0))
    k = F.col("k").cast("double")
    r, phi = F.sqrt((k + 0.5) / n), k * turn
    u, v = r * F.cos(phi) * F.col("a"), r * F.sin(phi) * F.col("b")
    spread = ellipses.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return spread.withColumns({"px": F.col("x") + F.cos("theta") * u - F.sin("theta") * v, "py": F.col("y") + F.sin("theta") * u + F.cos("theta") * v})
