"""Rules that go edge by edge in an order, run inside connected components.

What such a rule does to an edge depends on earlier edges that touch it, so on its component alone.
Components go to tasks whole, sorted by the order. The only edge of a component is taken without
looking at it, as most are; a rule sees the columns of other components. The few
that are too large for that are the callers' to decide in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.graph import connected_components
from lumenfold.session import discard, ship_package, stash

#: Edges of the largest component that a task takes.
MOST_EDGES = 200_000

#: From the columns of a component's edges in their order: which of them the rule takes; of a single edge, that one.
Rule = Callable[..., list[bool]]


def split_by_component(edges: DataFrame, u: Column, v: Column, most: int = MOST_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` with __c, their component, and those of components with more than ``most`` edges without it.

    ``u``, ``v``: the ends of an edge as longs; ends that share a number by chance are only joined.
    """
    keyed = stash(edges.withColumns({"__u": u, "__v": v}), "edges")
    parts = connected_components(keyed, "__u", "__v")
    sized = stash(keyed.join(parts.select(F.col("id").alias("__u"), F.col("component").alias("__c")), "__u").drop("__u", "__v"), "components")
    discard(keyed)
    large = stash(sized.groupBy("__c").agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select("__c"), "large")
    if large.isEmpty():
        return sized, None
    return sized.join(large, "__c", "left_anti"), sized.join(large, "__c", "left_semi").drop("__c")


def apply_in_order(edges: DataFrame, order: list[str], columns: list[str], rule: Rule) -> DataFrame:
    """The ``columns`` of the rows of ``edges`` (with __c) that a rule takes."""
    ship_package(edges.sparkSession)
    dealt = edges.repartition("__c").sortWithinPartitions("__c", *order).select("__c", *columns)

    def taken(table: pa.Table) -> pa.Table:
        """The rows taken of whole components."""
        c = table.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
        ends = np.append(starts[1:], len(c))
        mask = np.zeros(len(c), bool)
        mask[starts] = True
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if j - i > 1:
                mask[i:j] = rule(*[x.to_pylist() for x in table.slice(i, j - i).columns[1:]])
        return table.filter(pa.array(mask)).drop_columns(["__c"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the component that the last batch ends with
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(c != c[-1])[-1]) + 1 if c[0] != c[-1] else 0
            if rest and rest[0].column(0)[0].as_py() != c[-1]:
                yield from taken(pa.Table.from_batches([*rest, batch.slice(0, cut)])).to_batches()
                rest = []
            elif cut:
                yield from taken(pa.Table.from_batches([batch.slice(0, cut)])).to_batches()
            rest.append(batch.slice(cut))
        if rest:
            yield from taken(pa.Table.from_batches(rest)).to_batches()

    return dealt.mapInArrow(work, dealt.drop("__c").schema)


def matching(firsts: list, seconds: list, *_) -> list[bool]:
    """Takes (a, b, ...) while both ends are free."""
    used_a, used_b, out = set(), set(), []
    for a, b in zip(firsts, seconds, strict=True):
        ok = a not in used_a and b not in used_b
        if ok:
            used_a.add(a)
            used_b.add(b)
        out.append(ok)
    return out


def removal(firsts: list, seconds: list, losers: list, *_) -> list[bool]:
    """Takes (a, b, loser) unless an end is gone; then the loser is."""
    gone, out = set(), []
    for a, b, loser in zip(firsts, seconds, losers, strict=True):
        ok = a not in gone and b not in gone
        if ok:
            gone.add(loser)
        out.append(ok)
    return out


def yielding(laters: list, earliers: list, *_) -> list[bool]:
    """Takes (later, earlier, ...) where the later one is there yet and the earlier one was not taken; the later one goes."""
    gone, out = set(), []
    for later, earlier in zip(laters, earliers, strict=True):
        ok = later not in gone and earlier not in gone
        if ok:
            gone.add(later)
        out.append(ok)
    return out
