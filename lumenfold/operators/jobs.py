"""User-level jobs: source classification by named policies, labels, evaluation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.expr import axis_ratio, finite, reason_string
from lumenfold.operators import joins as J
from lumenfold.operators import rules as R
from lumenfold.operators import summaries as A
from lumenfold.operators.graph import connected_components
from lumenfold.operators.ordinary import fainter_of_close, marked, valid_ellipse
from lumenfold.operators.windows import stars_near_clusters
from lumenfold.session import stash

C = F.col


def classify_sources(sources: DataFrame, by: list[str], p: R.ClassPolicy = R.ClassPolicy(), flags: tuple[str, ...] = ("f_edge", "f_bad")) -> DataFrame:
    """(source_id, class, reason) by area, fill, brightness, magnitude, shape, flags, close pairs, containment and overlap.

    ``sources``: source_id, x, y, a, b, theta, area, mag, diff, fill, component, valid_kron, in_base and
    the flags. Classes come in the order in which later ones win: outside_base, b_ignore, a_failed,
    dropped_area, b_ignore for an invalid ellipse (also one without two positive finite axes), center_only,
    clean. With ``p.overlap_iou`` sources that would be clean and overlap so much, within
    ``p.neighbor_radius``, are center_only: both of a pair, or the smaller one by ``p.overlap_marks``.
    """
    flag_hit, flag_names = R.flag_rule({f: C(f) for f in flags})
    dropped, faint = R.a_rule(C("area"), C("mag"), p)
    base = C("in_base")
    good = C("valid_kron") & finite("a") & finite("b") & (C("a") > 0) & (C("b") > 0)
    hard = R.bright_ap2_rule(C("diff"), C("component"), False, p) & R.below(C("mag"), p.bright_mag)
    s = sources.withColumns({"ratio": axis_ratio(C("a"), C("b")), "dropped": base & good & dropped, "failed": base & good & (dropped | faint)})
    s = s.withColumn("candidate", base & good & ~C("failed")).withColumn("hollow", C("candidate") & R.fill_center_only(C("area"), C("fill"), p) & ~hard)
    s = s.withColumn("b_candidate", C("candidate") & ~C("hollow"))
    s = s.withColumn("removed", C("b_candidate") & (hard | R.b_rule(C("mag"), C("ratio"), C("diff"), F.lit(True), flag_hit, p)))
    s = stash(s.withColumns({"ordinary": C("b_candidate") & ~R.below(C("mag"), p.bright_mag), "hard": C("b_candidate") & hard, "flag_names": flag_names}), "basics")
    close = stash(J.close_pair_losers(s.filter("b_candidate AND NOT removed"), p.close_radius, by), "close")
    s = marked(s, close, "close", "source_id")
    left = s.filter("ordinary AND NOT removed AND NOT close")
    held = J.containment_losers(J.ellipse_overlap_join(left, None, by), p.containment)
    s = marked(s, held, "contains")
    out = C("removed") | C("close") | C("contains")
    s = s.withColumn("ambiguous", F.lit(False))
    if p.overlap_iou is not None:
        s = stash(s, "contained")
        over = J.ellipse_overlap_join(s.filter(C("b_candidate") & ~out), p.neighbor_radius, by).filter(C("iou") >= p.overlap_iou)
        smaller = F.when(C("a_area") <= C("b_area"), C("a")).otherwise(C("b"))
        hit = over.select(smaller.alias("id")) if p.overlap_marks == "smaller" else over.select(F.explode(F.array("a", "b")).alias("id"))
        s = marked(s.drop("ambiguous"), hit, "ambiguous")
    cls = (
        F.when(C("b_candidate") & ~out & ~C("ambiguous"), "clean")
        .when(C("ambiguous"), "center_only")
        .when(C("hollow"), "center_only")
        .when(base & ~good, "b_ignore")
        .when(C("dropped"), "dropped_area")
        .when(C("failed"), F.lit("dropped" if p.drop_a_failures else "a_failed"))
        .when(C("b_candidate"), "b_ignore")
        .otherwise("outside_base")
    )
    reasons = F.concat(
        F.array(
            F.when(C("dropped"), "A_area_gt_max").when(C("failed"), "A_faint_large"),
            F.when(C("hollow"), "center_only_fill"),
            F.when(C("hard"), "B_bright_ap2_kron"),
            F.when(C("close"), "B_close_center_fainter"),
            F.when(C("contains"), "B_large_contains_small"),
            F.when(C("ambiguous"), "overlap_iou"),
            F.when(base & ~good, "invalid_kron"),
            F.when(C("b_candidate") & out, "removed_by_B"),
        ),
        F.when(C("removed"), C("flag_names")).otherwise(F.array().cast("array<string>")),
    )
    return s.select("source_id", cls.alias("class"), reason_string(reasons).alias("reason"))


def classify_basics(sources: DataFrame, by: list[str], p: R.ClassPolicy = R.ClassPolicy(), faintest: float = 30.0) -> DataFrame:
    """(source_id, class, reason): dropped, ignore, bright or ordinary candidates, after the shared area and shape rules.

    A column ``center_ok`` says which centres lie on data: the others are ignored, whatever else holds.
    """
    dropped, faint = R.a_rule(C("area"), C("mag"), p)
    ok = C("valid_kron") & valid_ellipse() & finite("mag")
    blind = ~F.coalesce(C("center_ok"), F.lit(False)) if "center_ok" in sources.columns else F.lit(False)
    cases = [
        (blind, "ignore", "center_no_data"),
        (~C("in_base"), "dropped", "source_filter"),
        (~F.coalesce(ok, F.lit(False)), "ignore", "invalid"),
        (dropped, "dropped", "A_area_gt_max"),
        (faint, "dropped", "A_faint_large"),
        (R.above(C("mag"), faintest), "ignore", "B_mag_gt_max"),
        (R.above(axis_ratio(C("a"), C("b")), p.axis_ratio_max), "ignore", "B_axis_ratio"),
    ]
    state = F.struct(F.when(R.below(C("mag"), p.bright_mag), "bright").otherwise("ordinary").alias("class"), F.lit("").alias("reason"))
    for when, cls, why in reversed(cases):
        state = F.when(when, F.struct(F.lit(cls).alias("class"), F.lit(why).alias("reason"))).otherwise(state)
    s = stash(sources.withColumn("state", state), "basics")
    lost = fainter_of_close(s.filter(C("state.class").isin("bright", "ordinary")), p.close_radius, by)
    s = marked(s, lost, "lost")
    return s.select("source_id", F.when(C("lost"), "ignore").otherwise(C("state.class")).alias("class"), F.when(C("lost"), "B_close_pair_dimmer").otherwise(C("state.reason")).alias("reason"))


def bright_clusters(sources: DataFrame, stars: DataFrame, by: list[str], iou: float = 0.05, distance: float = 50.0, area_cap: float = 1e9, isolated_area: float = 500.0, source_match: float = 6.0, centroid_match: float = 10.0) -> DataFrame:
    """(by, source_id, cluster, members, label): labels of overlapping sources, and a strict centre for each star of a cluster.

    A source alone in its cluster that touches no other is clean, or center_only from ``isolated_area`` on. The members
    of a cluster that stars (by, star_id, x, y) match are restricted, and every such star is added with the id
    -star_id - 1 as strict; other clusters are ignored.
    """
    pairs = J.ellipse_pairs(sources, by).withColumn("iou", J.pixel_iou(C("s"), C("t"))).filter("iou > 0")
    over = stash(pairs.select(C("s.id").alias("a"), C("t.id").alias("b"), F.greatest("s.area", "t.area").alias("larger"), "d", "iou"), "overlaps")
    links = over.filter((C("iou") >= iou) & (C("d") <= distance) & (C("larger") < area_cap))
    found = connected_components(links).select(C("id").alias("source_id"), "component")
    touched = over.select(F.explode(F.array("a", "b")).alias("source_id")).distinct().withColumn("touched", F.lit(True))
    rows = sources.select(*by, "source_id", "x", "y", "area").join(found, "source_id", "left").join(touched, "source_id", "left").withColumn("cluster", F.coalesce("component", "source_id"))
    rows = stash(rows.join(rows.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").withColumn("isolated", (C("members") == 1) & C("touched").isNull()), "clusters")
    met = stash(stars_near_clusters(rows.filter("NOT isolated").select(*by, "cluster", "x", "y"), stars, source_match, centroid_match, by), "met")
    starred = met.select("cluster").distinct().withColumn("starred", F.lit(True))
    label = F.when(C("isolated"), F.when(C("area") < isolated_area, "clean").otherwise("center_only")).when(C("starred"), "restricted").otherwise("ignore")
    own = rows.join(starred, "cluster", "left").select(*by, "source_id", "cluster", "members", label.alias("label"))
    sizes = rows.select("cluster", "members").distinct()
    added = met.join(sizes, "cluster").select(*by, (-C("star_id") - 1).alias("source_id"), "cluster", "members", F.lit("strict").alias("label"))
    return own.unionByName(added)


def remeasure_rescue(sources: DataFrame, by: list[str], p: R.RescuePolicy = R.RescuePolicy()) -> DataFrame:
    """(source_id, class, reason) of the aperture outliers among ``sources`` after their Kron flux was measured anew.

    ``sources``: source_id, x, y, a, b, theta, area (of the new aperture), n_child, old_diff and new_diff
    (aperture less Kron magnitude), mag (aperture), fill (footprint in the aperture), ignored, clean and skip.
    Selected are ignored sources without children whose old difference passes the limit, unless ``skip``
    holds. Too large ones drop; small fill, faint and large, long, not measured or still far ones, and those
    that hold a smaller clean or rescued ellipse, are ignored; the others are clean or center_only by the
    new difference.
    """
    old, new = F.abs(C("old_diff")), F.abs(C("new_diff"))
    chosen = (C("n_child") == 0) & C("ignored") & ~F.coalesce(C("skip"), F.lit(False)) & R.above(old, p.threshold) & finite("x") & finite("y")
    long = axis_ratio(C("a"), C("b"))
    reasons = F.array_compact(F.array(
        F.when(~(finite("a") & finite("b") & finite("theta") & (C("a") > 0) & (C("b") > 0)), "invalid_refit_ellipse"),
        F.when(R.at_most(new, p.center_max) & R.below(C("fill"), p.least_fill), "small_footprint_large_aperture"),
        F.when(R.above(C("area"), p.area_max), "area_gt_max"),
        F.when(R.above(C("mag"), p.faint_mag) & R.above(C("area"), p.faint_area), "faint_and_large"),
        F.when(R.above(long, p.axis_ratio_max), "axis_ratio"),
        F.when(~finite(C("new_diff")), "invalid_new_diff").when(new > p.center_max, "new_diff"),
    ))
    s = stash(sources.withColumn("chosen", F.coalesce(chosen, F.lit(False))).withColumn("reasons", F.when(C("chosen"), reasons).otherwise(F.array().cast("array<string>"))), "remeasured")
    free = C("chosen") & (F.size("reasons") == 0)
    pool = s.filter(free | C("clean"))
    over = J.ellipse_overlap_join(pool, None, by)
    larger = F.when((C("a_area") < C("b_area")) & (C("in_b") >= p.containment), C("b")).when((C("b_area") < C("a_area")) & (C("in_a") >= p.containment), C("a"))
    s = marked(s.filter("chosen"), over.select(larger.alias("id")).filter("id is not null"), "holds")
    s = s.withColumn("reasons", F.when(C("holds") & (F.size("reasons") == 0), F.array(F.lit("contains_smaller"))).otherwise(C("reasons")))
    cls = F.when(F.array_contains("reasons", "area_gt_max"), "drop").when(F.size("reasons") > 0, "ignore").when(new < p.clean_max, "clean").otherwise("center_only")
    return s.select("source_id", cls.alias("class"), reason_string(C("reasons")).alias("reason"))


def photometry_eval(targets: DataFrame, predictions: DataFrame, radius: float, by: str, low: float, high: float, width: float) -> DataFrame:
    """Completeness and purity by bin of predictions matched greedily to targets, per group and for all."""
    m = J.greedy_match(J.pairs_within(predictions, targets, radius, [by], "det_id", "source_id"), [by])
    phot = predictions.join(m.select(C("a").alias("det_id"), C("b").alias("key")), "det_id", "left").select(C(by).alias("dataset"), "key", "mag")
    gt = targets.select(C(by).alias("dataset"), C("source_id").alias("key"), "mag", "keep")
    return A.completeness_purity_by_bin(gt, phot, low, high, width)


def split_builder(samples: DataFrame, narrow: list[str], share: float, n_train: int, seed: int) -> DataFrame:
    """(source, patch, part): validation patches, and a weighted draw of training patches that share no sky with them."""
    from lumenfold.operators.windows import split_guard

    parts = A.train_val_split(samples, share, ["source", "patch"], seed)
    validation = parts.filter("part = 'validation'")
    free = split_guard(parts.filter("part = 'train'"), validation, 0.0, 16.0)
    drawn = A.weighted_sample(A.candidate_weights(free.drop("part"), narrow), n_train, seed, ["source", "patch"])
    return drawn.select("source", "patch", F.lit("train").alias("part")).unionByName(validation.select("source", "patch", F.lit("validation").alias("part")).distinct())
