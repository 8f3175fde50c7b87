"""Quality rules: robust outliers among text statistics, by built-in functions alone.

Each text has a vector of transformed statistics. Per language and source, a minimum covariance
determinant (MCD) estimate gives location and scatter of the bulk of the vectors. Concentration steps
go from an estimate to mean and covariance of the share of vectors that lie nearest to it, which never
raises the determinant. They begin at three estimates (medians with quartile ranges, covariance of
spatial signs, covariance of hyperbolic tangents), and the one with the least determinant after a few
goes on until none of the groups' determinants falls. A diagonal floor keeps the determinant from being
nought where a bulk agrees in a statistic (the regularised MCD). A document whose Mahalanobis distance
is beyond the cutoff is rejected.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import discard, stash

_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Coverage of the estimate, and rows that a group of its own needs: with fewer, the covariance of
#: seven statistics says little, and the group's texts are measured with the rest of their language.
COVERAGE, LEAST_ROWS = 0.75, 60
#: Scatter of the nearest COVERAGE of a normal cloud with seven coordinates, of that of all of it:
#: P(chi2_9 <= q) / COVERAGE with P(chi2_7 <= q) = COVERAGE.
CONSISTENCY = 0.755
#: Concentration steps of every start, most steps of the best one, and the fall of a logarithm of the
#: determinant below which a group is at rest: the grid of distances alone moves it by some thousandths.
FIRST_STEPS, MOST_STEPS, AT_REST = 2, 20, 1e-2
#: Standard deviations that no coordinate's scatter falls below: they keep bulks that agree in a
#: statistic (no symbols at all, say) from rejecting every departure.
FLOORS = (0.5, 0.12, 0.15, 0.15, 0.15, 0.15, 0.15)
#: Distances beyond this are rejected. The squared distance of a normal vector with seven coordinates
#: passes it with probability 1e-5; statistics of texts have longer tails than that.
CUTOFF = 6.0
#: Steps of the grids on which quantiles are taken.
GRID, DISTANCE_GRID = 0.01, 0.02
#: Groups up to which their table of estimates is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "caps", "n_adjacent")
FEATURES = ("f_words", "f_length", "f_symbols", "f_dup_lines", "f_repeats", "f_caps", "f_adjacent")


def _repeat_marks(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(pairs: Column) -> Column:
        n = F.size(pairs)
        starts = F.transform(
            F.filter(
                F.transform(pairs, lambda p, k: F.when(((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(pairs, k + 1)["h"] == p["h"])), p["i"])),
                lambda i: i.isNotNull(),
            ),
            lambda i: i,
        )
        return F.sort_array(starts)

    def covered(starts: Column) -> Column:
        # Each start covers WINDOW words, but for those that the next start covers.
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
            lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).cast("long").alias("n"), s.cast("long").alias("last")),
            lambda acc: acc["n"],
        )

    once = F.transform(F.array(placed), marked)
    return F.element_at(F.transform(once, covered), 1)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, caps and n_adjacent (long).

    Null texts count as empty. ``caps``: letters A to Z; ``n_adjacent``: words equal to the one before.
    Columns of ``docs`` named like a new one give way.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [c for c in docs.columns if c not in (text_col, *STATISTICS)]
    words = F.filter(F.split(F.col("__text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(_WORD))
    out = docs.select(*rest, text.alias("__text"))
    out = out.select(*rest, words.alias("__words"), lines.alias("__lines"), F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace("__text", "[^A-Z]+", "")).cast("long").alias("caps"))
    out = out.select(*rest, "n_symbols", "caps", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    window = F.when(F.size("__hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    adjacent = F.size(F.filter("__hashes", lambda h, i: F.coalesce(h == F.get("__hashes", i - 1), F.lit(False)))).cast("long")
    out = out.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "caps", adjacent.alias("n_adjacent"), window.alias("__windows"))
    repeats = F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0).cast("long")).otherwise(_repeat_marks(F.col("__windows")))
    return out.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "caps", "n_adjacent")


def features() -> dict[str, Column]:
    """The transformed statistics: logarithms of sizes, and shares spread near nought."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    spread = lambda a, b, k: F.log1p(a / b * k)
    return {
        "f_words": F.log1p("n_words"),
        "f_length": F.log(chars / n),
        "f_symbols": spread(F.col("n_symbols"), chars, 20.0),
        "f_dup_lines": spread(F.col("n_dup_lines"), n, 20.0),
        "f_repeats": spread(F.col("n_repeat_words"), n, 2.0),
        "f_caps": spread(F.col("caps"), chars, 4.0),
        "f_adjacent": spread(F.col("n_adjacent"), n, 10.0),
    }


_P = range(len(FEATURES))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]


def _small(table: DataFrame, n: int) -> DataFrame:
    """``table`` of some rows a group; ``n``: groups."""
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def _with_distance(rows: DataFrame) -> DataFrame:
    for i, f in enumerate(FEATURES):  # one coordinate a step, so that no expression is written out twice
        left = F.col(f) - F.col(f"m{i}")
        for j in range(i):  # forward substitution with the Cholesky root of the scatter
            left = left - F.col(f"l{i}{j}") * F.col(f"__y{j}")
        rows = rows.withColumn(f"__y{i}", left / F.col(f"l{i}{i}"))
    total = functools.reduce(lambda a, b: a + b, [F.col(f"__y{i}") * F.col(f"__y{i}") for i in _P])
    return rows.withColumn("distance", F.sqrt(total)).drop(*[f"__y{i}" for i in _P])


def _cholesky(table: DataFrame, start: int | None = None) -> DataFrame:
    """``table`` of __group, start, n_rows, m<i> and s<i><j> (scatter) with the root l<i><j>, and logdet, of the scatter."""
    if start is not None:
        table = table.withColumn("start", F.lit(start))
    for i, j in _PAIRS:
        value = F.col(f"s{i}{j}")
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}"))
    logdet = functools.reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in _P])
    return table.select("__group", "start", "n_rows", *[f"m{i}" for i in _P], *[f"l{i}{j}" for i, j in _PAIRS], logdet.alias("logdet"))


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group as an estimate, from counts on a fixed grid."""
    long = rows.select("__group", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f) / GRID).cast("long").alias("cell")) for i, f in enumerate(FEATURES)])).alias("x")).select("__group", "x.i", "x.cell")
    cells = long.groupBy("__group", "i", "cell").count()
    order = Window.partitionBy("__group", "i")
    run = cells.withColumns({"__n": F.sum("count").over(order), "__upto": F.sum("count").over(order.orderBy("cell"))})
    at = lambda q: F.min(F.when(F.col("__upto") >= q * F.col("__n"), F.col("cell"))) * GRID
    found = run.groupBy("__group", "i").agg(F.max("__n").alias("n_rows"), at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"))
    one = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = found.groupBy("__group").agg(F.max("n_rows").alias("n_rows"), *[one(i, "mid").alias(f"m{i}") for i in _P], *[F.greatest(one(i, "scale"), F.lit(FLOORS[i])).alias(f"d{i}") for i in _P])
    return _cholesky(wide.withColumns({f"s{i}{j}": F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0) for i, j in _PAIRS}), 0)


def _starts(rows: DataFrame, medians: DataFrame, n: int) -> DataFrame:
    """``medians`` and two more estimates about them: covariances of spatial signs, and of hyperbolic tangents."""
    z = rows.join(_small(medians, n), "__group").withColumns({f"__z{i}": (F.col(f) - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i, f in enumerate(FEATURES)})
    z = z.withColumn("__long", functools.reduce(lambda a, b: a + b, [F.col(f"__z{i}") * F.col(f"__z{i}") for i in _P]))
    z = z.select("__group", "__long", *[f"__z{i}" for i in _P], *[F.tanh(f"__z{i}").alias(f"__t{i}") for i in _P])
    sign = lambda i, j: F.avg(F.when(F.col("__long") > 0, F.col(f"__z{i}") * F.col(f"__z{j}") / F.col("__long")).otherwise(0.0)) * len(FEATURES)
    sums = z.groupBy("__group").agg(*[sign(i, j).alias(f"u{i}{j}") for i, j in _PAIRS], *[F.avg(F.col(f"__t{i}") * F.col(f"__t{j}")).alias(f"t{i}{j}") for i, j in _PAIRS])
    wide = medians.join(_small(sums, n), "__group")
    out = medians
    for start, kind in ((1, "u"), (2, "t")):
        scatter = {f"s{i}{j}": F.col(f"{kind}{i}{j}") * F.col(f"l{i}{i}") * F.col(f"l{j}{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
        out = out.unionByName(_cholesky(wide.withColumns(scatter).drop("logdet"), start))
    return out


def _concentrate(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """One concentration step of every estimate: mean and scatter of the COVERAGE share of its group that is nearest."""
    key = ["__group", "start"]
    near = _with_distance(rows.join(_small(table, n), "__group")).withColumn("__cell", F.floor(F.col("distance") / DISTANCE_GRID)).select(*key, "n_rows", "__cell", *FEATURES)
    cells = near.groupBy(*key, "n_rows", "__cell").count()
    run = cells.withColumn("__upto", F.sum("count").over(Window.partitionBy(*key).orderBy("__cell")))
    reach = run.groupBy(*key).agg(F.min(F.when(F.col("__upto") >= COVERAGE * F.col("n_rows"), F.col("__cell"))).alias("__last"))
    inside = near.join(_small(reach, n), key).filter(F.col("__cell") <= F.col("__last"))
    sums = inside.groupBy(*key).agg(F.max("n_rows").alias("n_rows"), *[F.avg(FEATURES[i]).alias(f"m{i}") for i in _P], *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in _PAIRS])
    return _cholesky(sums.withColumns({f"s{i}{j}": (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) / CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}))


def _least_determinant(table: DataFrame) -> DataFrame:
    """Of each group the estimate with the least determinant; of equal ones the first start."""
    names = [c for c in table.columns if c != "__group"]
    return table.groupBy("__group").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("x")).select("__group", "x.*")


def estimates(rows: DataFrame, n: int) -> DataFrame:
    """The MCD estimate of each __group of ``rows`` (with FEATURES); ``n``: groups."""
    medians = stash(_medians(rows), "medians")
    table = stash(_starts(rows, medians, n), "starts")
    discard(medians)
    for _ in range(FIRST_STEPS):
        table, old = stash(_concentrate(rows, table, n), "estimates"), table
        discard(old)
    table, old = stash(_least_determinant(table), "estimates"), table
    discard(old)
    for _ in range(MOST_STEPS - FIRST_STEPS):
        new = stash(_concentrate(rows, table, n), "estimates")
        before = table.select("__group", F.col("logdet").alias("before"))
        at_rest = new.join(_small(before, n), "__group").filter(F.col("before") - F.col("logdet") > AT_REST).isEmpty()
        if at_rest:
            discard(new)
            break
        better = stash(_least_determinant(table.unionByName(new)), "estimates")
        discard(table, new)
        table = better
    return table


def outliers(rows: DataFrame, lang_col: str = "lang", source_col: str = "source", least: int = LEAST_ROWS, fitted: str | Column = "true") -> DataFrame:
    """``rows`` (with FEATURES) with ``distance`` double from the MCD estimate of their group.

    A group is a language and source; those with under ``least`` rows join the rest of their language,
    and a rest with too few rows the rest of all. Null languages and sources are values of their own.
    Estimates are of the rows for which ``fitted`` holds; all rows are measured, but for those of a
    group that has no such row, which have a null distance.
    """
    fitted = F.expr(fitted) if isinstance(fitted, str) else fitted
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`")), F.lit("?"))
    rest = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in FEATURES])
    rows = rows.select(name(lang_col).alias("__lang"), F.concat_ws("\x00", name(lang_col), name(source_col)).alias("__pair"), fitted.alias("__fit"), rest.alias("__row"), *FEATURES)
    sizes = rows.groupBy("__lang", "__pair").agg(F.count_if("__fit").alias("__n"))
    small = F.sum(F.when(F.col("__n") < least, F.col("__n")).otherwise(0)).over(Window.partitionBy("__lang"))
    group = F.when(F.col("__n") >= least, F.col("__pair")).when(small >= least, F.col("__lang")).otherwise("")
    sizes = stash(sizes.select("__pair", group.alias("__group")), "groups")
    n = sizes.count()
    rows = stash(rows.join(_small(sizes, n), "__pair").select("__group", "__fit", "__row", *FEATURES), "vectors")
    discard(sizes)
    table = estimates(rows.filter("__fit").select("__group", *FEATURES), n)
    return _with_distance(rows.join(_small(table, n), "__group", "left")).select("__row.*", *FEATURES, "distance")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without its text, with the base statistics, base_failed, distance and kept.

    A text fails the base rules with under 20 words, or with over 30 percent of its words in repeated
    windows of eight. It is kept if it passes them and its distance is at most ``cutoff``. Estimates
    come from the texts that pass; distances of the others are measured against them too, and are null
    where no text of their group passes. Null texts are empty and fail; long texts count whole. Repeated
    rows stay, ties at the cutoff are kept, columns of ``docs`` named like a new one give way, and an
    empty table gives none.
    """
    clash = [c for c in docs.columns if c in (*FEATURES, "distance", "base_failed", "kept") and c not in (text_col, lang_col, source_col)]
    rows = statistics(docs.drop(*clash), text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stash(rows.withColumns(features()).withColumn("base_failed", failed), "statistics")
    out = outliers(rows, lang_col, source_col, fitted=~F.col("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).drop(*FEATURES, "caps", "n_adjacent")
