"""Connected components over an edge table, by rounds that contract it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import discard, ship_package, stash

#: Edges that are left at most when one task ends the work.
FINISH_EDGES = 100_000


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in ``pairs`` (n x 2), in order, and the least value that pairs connect each with."""
    members, at = np.unique(pairs, return_inverse=True)
    up = list(range(len(members)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in at.reshape(-1, 2).tolist():
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    return members, members[[top(i) for i in range(len(members))]] if len(members) else members


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    if found:
        ids, least = forest(np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.int64())], names=["id", "up"])


def _edges(u: Column, v: Column, table: DataFrame) -> DataFrame:
    """Distinct edges without loops and nulls, each once, the lesser end first."""
    return table.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), (u.isNotNull() & v.isNotNull() & (u != v)).alias("__real")).filter("__real").select("u", "v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish: int = FINISH_EDGES) -> DataFrame:
    """(id, component) for every endpoint of ``edges`` (long): the least id that it reaches.

    In each round a node goes to the first of itself and its neighbours, and edges are relabelled;
    loops and repeated edges go, so that tables shrink round by round: stars at once when nodes are
    ordered by id, and long paths by a constant share in the rounds that order them by a hash. What
    is left below ``finish`` edges one task ends. Every round is a table in the shared folder, so that
    a lost executor costs a re-read. Nulls and loops are ignored.
    """
    ship_package(edges.sparkSession)
    live = stash(_edges(F.col(a).cast("long"), F.col(b).cast("long"), edges), "edges")
    hung: list[DataFrame] = []
    while (left := live.count()) > finish:
        k = len(hung)
        rank = lambda c, k=k: F.struct((F.col(c) if k % 2 == 0 else F.xxhash64(F.lit(k), F.col(c))).alias("rank"), F.col(c).alias("id"))
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        up = stash(first.select(F.col("u").alias("id"), F.least(rank("u"), F.col("near"))["id"].alias("up")), "round")
        at = lambda end, up=up: up.select(F.col("id").alias(end), F.col("up").alias(f"{end}_up"))
        rest = stash(_edges(F.col("u_up"), F.col("v_up"), live.join(at("u"), "u").join(at("v"), "v")), "edges")
        discard(live)
        live = rest
        hung.append(up)
    labels = stash(live.coalesce(1).mapInArrow(_one_task, "id long, up long"), "labels") if left or not hung else None
    discard(live)
    for up in reversed(hung):
        if labels is None:
            labels = up
            continue
        over = labels.select(F.col("id").alias("up"), F.col("up").alias("top"))
        made = stash(up.join(over, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "labels")
        discard(labels, up)
        labels = made
    if len(hung) < 2:
        return labels.select("id", F.col("up").alias("component"))
    least = labels.groupBy("up").agg(F.min("id").alias("component"))
    out = stash(labels.join(least, "up").select("id", "component"), "components")
    discard(labels)
    return out
