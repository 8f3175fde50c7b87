"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words takes each of its documents in r expected copies: the
whole part of the expectation for certain, the rest with that inclusion probability. The sample of
the rest has a fixed size: documents are ranked by the odds of a uniform number divided by the odds
of their inclusion, and taken in that order until the source's missing words are reached. With
weights, documents of one source differ in their expectations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import discard, stash

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Sources up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with target, the words that the mix should take of each.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words by
    them. A target stops at ``most`` times its source; the excess is shared anew by weight until none
    is above. With f words for each unit of weight a target is min(weight * f, most * size): sources
    are full in the order of most * size / weight, so a running sum over that order finds f. The
    table has one row a source, summed before it comes here: its windows take all sources in one task,
    a row of three numbers each, as their order by name and one level for all of them need.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    numbered = sources.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    whole = Window.partitionBy(F.lit(0))
    fill = Window.orderBy("__full", F.col("source").isNull(), "source")
    capped = numbered.withColumn("__cap", F.col("source_size") * most).withColumn("__full", F.col("__cap") / F.col("__weight"))
    run = capped.withColumns({
        "__budget": F.sum("source_size").over(whole) * share,
        "__before": F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__open": F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    # The level at which all sources from this one on are still open; the first that holds is it.
    level = (F.col("__budget") - F.col("__before")) / F.col("__open")
    found = run.withColumn("__level", F.min(F.when(level <= F.col("__full"), F.struct(F.col("__full"), level.alias("level")))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("__weight") * F.col("__level"), F.col("__cap")), F.col("__cap"))
    return found.select("source", "source_size", target.alias("target"))


def _drawn(rows: DataFrame, aims: DataFrame, n_sources: int, most: float, seed: int) -> DataFrame:
    """``rows`` (__id, source, size, __w) with their source's columns in ``aims``, and __sure copies and __odds of one more.

    Both hang on the row and its source alone. Expected copies are in proportion to the weight; what the
    cap cuts off is left to the gap that the order fills.
    """
    ratio = F.when(F.col("__weighted") > 0, F.col("target") / F.col("__weighted")).otherwise(0.0)
    expected = F.least(F.lit(float(most)), ratio * F.col("__w"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__id").cast("string"), F.col("size").cast("string")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = rows.join(_small(aims.withColumnRenamed("source", "__s"), n_sources), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    drawn = drawn.withColumn("__expected", expected).withColumn("__sure", F.floor(F.col("__expected") + 1e-9))
    rest = F.greatest(F.lit(0.0), F.col("__expected") - F.col("__sure"))
    odds = (uniform / (1 - uniform)) / (rest / (1 - rest))
    return drawn.withColumn("__odds", F.when(rest > 1e-9, odds)).drop("__expected")


def _chosen(base: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """``base`` (__id, source, size, __w) with target, __sure, __odds and __more (0 or 1); the sources' aims; and their number."""
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("__w")).alias("__weighted"), F.count("*").alias("__rows"))
    totals = stash(totals, "sources")
    n_sources, largest = totals.agg(F.count("*"), F.max("__rows")).first()
    aims = targets(totals.select("source", "source_size"), weights, share, most).join(totals.select(F.col("source").alias("__s"), "__weighted", "__rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    aims = stash(aims, "targets")
    discard(totals)
    drawn = _drawn(base, aims, n_sources, most, seed)
    # Running sums over a source without sorting it in one task: sums by slice of the order, then
    # running sums over the slices, then an order within the one slice where the gap closes.
    slices = 1 << max(6, min(16, int((largest or 1) ** 0.5).bit_length()))
    slice_of = F.floor(F.when(F.col("__odds") < 1, F.col("__odds") / 2).otherwise(1 - 0.5 / F.col("__odds")) * slices).cast("int")
    drawn = drawn.withColumn("__slice", F.when(F.col("__odds").isNotNull(), F.least(slice_of, F.lit(slices - 1))))
    sums = drawn.groupBy("source", "__slice").agg(F.sum("size").alias("__words"), F.sum(F.col("size") * F.col("__sure")).alias("__certain"), F.max("target").alias("target"))
    running = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__gap", F.col("target") - F.sum("__certain").over(Window.partitionBy("source")))
    sums = sums.filter(F.col("__slice").isNotNull()).withColumn("__so_far", F.coalesce(F.sum("__words").over(running), F.lit(0)))
    cut = sums.filter(F.col("__so_far") < F.col("__gap")).groupBy("source").agg(F.max_by(F.struct("__slice", "__so_far", "__gap"), "__slice").alias("__cut"))
    cut = stash(cut.select("source", "__cut.*").toDF("__s", "__at", "__so_far", "__gap"), "cuts")
    placed = drawn.join(_small(cut, n_sources), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    inside = Window.partitionBy("source").orderBy("__odds", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    in_cut = placed.filter(F.col("__slice") == F.col("__at")).withColumn("__upto", F.col("__so_far") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # Of the document that crosses the gap, whichever of with and without it comes nearer.
    in_cut = in_cut.withColumn("__more", (F.col("__upto") + F.col("size") / 2 <= F.col("__gap")).cast("int"))
    others = placed.filter(F.col("__slice").isNull() | F.col("__at").isNull() | (F.col("__slice") != F.col("__at"))).withColumn("__more", F.coalesce(F.col("__slice") < F.col("__at"), F.lit(False)).cast("int"))
    names = ["__id", "source", "size", "source_size", "target", "__sure", "__odds", "__more"]
    return others.select(*names).unionByName(in_cut.select(*names)), aims, n_sources


def pareto_mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a row of ``docs``: id_col, size, source_size (long), target (double), copies, taken (long).

    ``size`` (default: words of ``text_col``, null 0) is what targets count. ``weight`` makes the
    documents of a source differ in expectation: up to the cap it is in proportion to it.
    ``copies`` is a whole number from 0 to ``most``, ``taken`` is copies times size. A source's taken
    words miss its target by less than the document that comes last in the order, and by no more
    than the best document that could close the gap. Draws come from a hash of id_col and ``seed``,
    so reruns agree; equal ids are told apart by their size, and rows equal in both are alike.
    Null ids, texts and sources are values of their own. Texts count whole, however long; columns of
    ``docs`` other than the named ones are not read. An empty table gives an empty one.
    """
    base = stash(docs.select(*_base(size, id_col, source_col, text_col, weight)), "sizes")
    chosen, _, _ = _chosen(base, weights, share, most, seed)
    copies = (F.col("__sure") + F.col("__more")).cast("long")
    return chosen.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _base(size: Column | None, id_col: str, source_col: str, text_col: str, weight: Column | None) -> list[Column]:
    size = word_count(f"`{text_col}`") if size is None else size
    return [F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("source"), size.cast("long").alias("size"), (F.lit(1.0) if weight is None else F.greatest(F.lit(0.0), weight.cast("double"))).alias("__w")]


def with_copies(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with copies (long) as :func:`pareto_mix` gives them, without moving a text.

    What a source takes beyond its sure copies is the first part of its order, so the last document in
    it, one a source, tells every row by itself. Of rows equal in id and size at that place as many are taken as
    :func:`pareto_mix` takes; which of them hangs on where they are written, so they are written first.
    """
    base = stash(docs.select(*_base(size, id_col, source_col, text_col, weight)), "sizes")
    chosen, aims, n_sources = _chosen(base, weights, share, most, seed)
    key = F.struct(F.col("__odds").alias("odds"), F.col("__id").alias("id"), F.col("size").alias("size"))
    last = chosen.filter("__more = 1").groupBy("source").agg(F.max(key).alias("__last")).withColumnRenamed("source", "__s")
    aims = stash(aims.join(last, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "order")
    # How many rows stand at the last place, and how many of them are taken: a row a source.
    at_last = chosen.join(_small(aims.select(F.col("source").alias("__s"), "__last"), n_sources), F.col("source").eqNullSafe(F.col("__s"))).filter(key == F.col("__last"))
    ties = stash(at_last.groupBy("__s").agg(F.count("*").alias("__equal"), F.sum("__more").alias("__taken")).filter("__taken < __equal").withColumn("__has", F.lit(True)), "ties")
    discard(base)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("__row"), *_base(size, id_col, source_col, text_col, weight))
    drawn = _drawn(rows, aims, n_sources, most, seed)
    more = F.coalesce(F.col("__odds").isNotNull() & (key <= F.col("__last")), F.lit(False)).cast("int")
    copies = lambda more: (F.col("__sure") + more).cast("long").alias("copies")
    if ties.isEmpty():
        return drawn.select("__row.*", copies(more))
    tied = drawn.join(_small(ties, n_sources), F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("__tie", F.coalesce(F.col("__has") & (key == F.col("__last")), F.lit(False)))
    placed = stash(tied.filter("__tie").select("__row", "__s", "__sure", "__taken", F.monotonically_increasing_id().alias("__at")), "tied")
    # A row's place among its equals: those in parts before its own, and those before it in its part.
    part = F.shiftrightunsigned("__at", 33)
    counts = placed.groupBy("__s", part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__s").alias("__of"), F.col("__part").alias("__of_part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__at")) - 1
    ranked = placed.withColumn("__part", part).withColumn("__in", inside).join(starts, F.col("__s").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__of_part")))
    rest = tied.filter("NOT __tie").select("__row.*", copies(more))
    return rest.unionByName(ranked.select("__row.*", copies((F.col("__from") + F.col("__in") < F.col("__taken")).cast("int"))))
