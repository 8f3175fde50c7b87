"""Exact k-means in rounds, sparing distances by bounds that are loosened by the norm of a total displacement.

A vector keeps a lower bound of its distance to every centroid, with the round in which that distance
was last evaluated. All centroids of all rounds are retained, so a bound of round T is loosened by the
distance between that centroid's places of now and of T: the norm of the sum of its moves, which is at
most the sum of their norms. Where the bounds leave a doubt the distance is evaluated anew, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import discard, ship_package, stash

#: Components are clipped at this absolute value, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Components up to which the sums of a matrix product are exact in doubles.
_EXACT = 1 << 22
#: Components that one step of NumPy work takes at most.
STEP = 1 << 20
MOST_ROUNDS = 255
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(__id, x): vectors of ``width`` components, none null or not finite, as integers floor(scale * component)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = (F.size(v) == width) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    at_most = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    part = lambda c: at_most(F.floor(at_most(c) * scale).cast("long")).cast("int")
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").alias("__id"), F.transform(v, part).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:id``, in that order; equal ids in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")).cast("binary"), 256)
    return np.array([r.x for r in rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``x`` (n x d) to all ``c`` (k x d)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([np.square(x - one).sum(1) for one in c], 1)


def _below(squares: np.ndarray) -> np.ndarray:
    """A single-precision number that is at most the root of each of ``squares``."""
    return np.maximum(np.nextafter(np.sqrt(squares.astype(float)).astype(np.float32), np.float32(0)) * np.float32(1 - 2e-7), np.float32(0))


class Bounds:
    """What is known of some vectors: cluster, exact squared distance to it, lower bounds to all centroids, and the rounds of each."""

    def __init__(self, cluster: np.ndarray, square: np.ndarray, low: np.ndarray, since: np.ndarray):
        self.cluster, self.square, self.low, self.since = cluster, square, low, since

    @classmethod
    def of_round_0(cls, x: np.ndarray, c: np.ndarray) -> Bounds:
        found = distances(x, c)
        cluster = found.argmin(1)
        return cls(cluster, found[np.arange(len(x)), cluster], _below(found), np.zeros(found.shape, np.uint8))

    def advance(self, x: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Bring the clusters to the last centroids of ``history`` (rounds x k x d); distances evaluated for each vector.

        ``square`` stays that of the round in ``since`` where no bound failed.
        """
        now, t = history[-1], len(history) - 1
        moved = np.sqrt(np.square((history - now).astype(float)).sum(2)) * (1 + 1e-12)
        n, k = self.low.shape
        rows, every = np.arange(n), np.arange(k)
        evaluated = np.zeros(n, np.int32)
        low = self.low - moved[self.since, every]
        high = np.sqrt(self.square.astype(float)) * (1 + 1e-12) + moved[self.since[rows, self.cluster], self.cluster]
        low[rows, self.cluster] = np.inf
        doubt = np.flatnonzero((low <= high[:, None]).any(1))
        if not len(doubt):
            return evaluated
        # The distance to the own centroid first: it settles most doubts.
        own = self.cluster[doubt]
        exact = np.square(x[doubt] - now[own]).sum(1)
        evaluated[doubt] += 1
        self._set(doubt, own, exact, t)
        best, square = own.copy(), exact.copy()
        open_row, open_to = np.nonzero(low[doubt] <= (np.sqrt(exact.astype(float)) * (1 + 1e-12))[:, None])
        for i in range(0, len(open_row), max(1, STEP // x.shape[1])):
            some, to = open_row[i : i + STEP // x.shape[1]], open_to[i : i + STEP // x.shape[1]]
            found = np.square(x[doubt[some]] - now[to]).sum(1)
            self._set(doubt[some], to, found, t)
            np.add.at(evaluated, doubt[some], 1)
            # Of a vector's pairs the least distance, then the smaller number, comes first.
            order = np.lexsort((to, found, some))
            lead = order[np.flatnonzero(np.diff(some[order], prepend=-1))]
            at, d, j = some[lead], found[lead], to[lead]
            nearer = (d < square[at]) | ((d == square[at]) & (j < best[at]))
            best[at[nearer]], square[at[nearer]] = j[nearer], d[nearer]
        self.cluster[doubt], self.square[doubt] = best, square
        return evaluated

    def _set(self, rows: np.ndarray, to: np.ndarray, squares: np.ndarray, t: int) -> None:
        self.low[rows, to], self.since[rows, to] = _below(squares), t


_STATE = "x array<int>, cluster int, square long, low binary, since binary, evaluated int"


def _assign(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """``rows`` (__id, x, and from round 1 on the state) with the state for the last centroids of ``history``."""
    ship_package(rows.sparkSession)
    k, width = history.shape[1:]
    id_type = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP // (width + k)):
                batch = whole.slice(i, STEP // (width + k))
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                x = column["x"].flatten().to_numpy().reshape(-1, width).astype(np.int64)
                if len(history) == 1:
                    state = Bounds.of_round_0(x, history[0])
                    evaluated = np.full(len(x), k, np.int32)
                else:
                    low, since = (np.frombuffer(b"".join(column[c].to_pylist()), kind).reshape(-1, k).copy() for c, kind in (("low", np.float32), ("since", np.uint8)))
                    state = Bounds(column["cluster"].to_numpy().astype(np.int64), column["square"].to_numpy().copy(), low, since)
                    evaluated = column["evaluated"].to_numpy() + state.advance(x, history)
                packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (state.low, state.since)]
                yield pa.RecordBatch.from_arrays([column["__id"], column["x"], pa.array(state.cluster, pa.int32()), pa.array(state.square, pa.int64()), *packed, pa.array(evaluated, pa.int32())], names=["__id", "x", "cluster", "square", "low", "since", "evaluated"])

    return rows.mapInArrow(run, f"__id {id_type}, {_STATE}")


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floors of the means of all clusters; that of an empty one stays."""
    width = before.shape[1]
    out = before.copy()
    # A row a cluster, whatever the number of vectors.
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(width)]).alias("sums")).collect():
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster int, distance long (squared), cluster_inertia, inertia long, centroid_sha256, evaluated int.

    Vectors of ``width`` components without nulls, NaN and infinities, each component as floor(scale *
    component), are clustered around ``k`` centroids: the vectors with the least SHA-256 of ``seed:id``
    (null ids last). ``rounds`` times every vector goes to the nearest one (of equally near ones the
    smaller number) and centroids go to the floor of their vectors' means; then vectors are assigned
    once more. ``evaluated`` is the number of exact distances that a vector needed. Other vectors
    have no row; repeated rows and ids each keep theirs; with fewer than ``k`` vectors there are as
    many centroids as vectors; an empty table gives none. Components beyond 2 ** 27 count as that; sums that
    no long holds are the largest long. Columns of ``vectors`` other than the two are not read.
    """
    if not 0 <= rounds < MOST_ROUNDS:
        raise ValueError(f"rounds must be below {MOST_ROUNDS}")
    spark = vectors.sparkSession
    rows = stash(integer_vectors(vectors, id_col, vector_col, width, scale), "vectors")
    start = first_centroids(rows, k, seed)
    id_type = rows.schema["__id"].dataType.simpleString()
    if not len(start):
        return rows.select(F.col("__id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("evaluated", "int"))])
    history, state = start[None], rows
    for _ in range(rounds):
        state, before = stash(_assign(state, history), "state"), state
        discard(before)
        history = np.concatenate([history, _means(state, history[-1])[None]])
    last = _assign(state, history).select("__id", "x", "cluster", "evaluated")
    last = stash(_exact(last, history[-1], id_type), "assigned")
    discard(state)
    sums = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(j, min(sums.get(j, 0), _LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1].tolist())]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    whole: Column = F.lit(min(sum(sums.values()), _LONG)).cast("long")
    return last.join(F.broadcast(named), "cluster").select(F.col("__id").alias(id_col), "cluster", "distance", "cluster_inertia", whole.alias("inertia"), "centroid_sha256", "evaluated")


def _exact(rows: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """``rows`` (__id, x, cluster, evaluated) with the squared distance to their centroid instead of x."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width).astype(np.int64)
            cluster = batch.column(2)
            d = np.square(x - centroids[cluster.to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array(d), batch.column(3)], names=["__id", "cluster", "distance", "evaluated"])

    return rows.mapInArrow(run, f"__id {id_type}, cluster int, distance long, evaluated int")
