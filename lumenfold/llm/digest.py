"""Exact document fingerprints of canonical text, by built-in functions alone.

The canonical text has composed accents, plain forms of compatibility characters, one case and
single spaces. Its fingerprint is 128 bits of xxhash64 under two seeds. Documents with one
fingerprint form a bucket, and inside a bucket their canonical bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import stash

#: Rows of one slice of the document order, and the most slices that are made.
SLICE_ROWS, MOST_SLICES = 4096, 128 * 128
#: Rows up to which a list of repeated fingerprints is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _nfkc(text: Column) -> Column:
    """NFKC over all planes, by the ICU library that Spark has for its collations."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _folded(text: Column) -> Column:
    """Full case folding over all planes, by the same library."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


# White space but for the plain space, and the characters below U+0100 with another NFKC form.
_OTHER_SPACE = r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNUSUAL = r"[\x{a8}\x{aa}\x{af}\x{b2}-\x{b5}\x{b8}-\x{ba}\x{bc}-\x{be}\x{100}-\x{10ffff}]"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is empty.

    NFKC (compatibility forms, marks in canonical order, composed; Hangul too) of the full case folding
    of the NFKC form; runs of white space are one space, and none at the ends. Texts of characters below
    U+0100 that NFKC leaves alone need lower case and ss for ß alone.
    """
    out = F.coalesce(text, F.lit(""))
    plain = F.replace(F.lower(out), F.lit("ß"), F.lit("ss"))
    folded = F.when(out.rlike(_UNUSUAL), _nfkc(_folded(_nfkc(out)))).otherwise(plain)
    # What is a single plain space already stays untouched.
    runs = f" ?[{_OTHER_SPACE}][ {_OTHER_SPACE}]*| {{2,}}[ {_OTHER_SPACE}]*"
    return F.trim(F.regexp_replace(folded, runs, " "))


def fingerprint(canon: Column) -> Column:
    """32 hexadecimal digits: xxhash64 of a canonical text under two seeds."""
    return _bind(canon, lambda c: F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), c)), 16, "0") for seed in (1, 2)])))


def slice_bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that part ``docs`` into slices of about ``SLICE_ROWS`` rows; at most ``MOST_SLICES``."""
    n = min(MOST_SLICES, max(1, -(-docs.count() // SLICE_ROWS)))
    found = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("b")).first()["b"] if n > 1 else []
    return sorted(set(found or []))


def slice_of(ids: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` up to an id; -1 for null. Looks into a list of lists, one after another."""
    if not bounds:
        return F.when(ids.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    k = F.size(F.filter(outer, lambda b: b <= ids))
    within = F.size(F.filter(F.element_at(inner, F.greatest(k, F.lit(1))), lambda b: b <= ids))
    return F.when(ids.isNull(), -1).when(k == 0, 0).otherwise((k - 1) * step + within)


def with_next(docs: DataFrame, text_col: str, extra: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``extra`` and next_<c> for it and ``text_col``: the value in the next row by descending id.

    After the last row comes the first. Null ids come last; equal ids are in order of their texts.
    Rows are dealt out by slices of the order, and each slice also gets the first row of the next
    one, so that no task sees the whole order.
    """
    bounds = slice_bounds(docs, id_col)
    cut = docs.withColumns({"__slice": slice_of(F.col(id_col), bounds), "__ghost": F.lit(0)})
    heads = docs.select(id_col).groupBy(slice_of(F.col(id_col), bounds).alias("__s")).agg(F.max(id_col).alias("__head"))
    # At most MOST_SLICES + 1 rows: one a slice.
    heads = heads.withColumn("__to", F.coalesce(F.lag("__s").over(Window.orderBy(F.desc("__s"))), F.first("__s").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = docs.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("__head")))
    ghosts = first.groupBy("__to").agg(F.min(text_col).alias(text_col)).select(F.col("__to").alias("__slice"), F.lit(1).alias("__ghost"), text_col)
    both = cut.unionByName(ghosts, allowMissingColumns=True).withColumns(extra)
    order = Window.partitionBy("__slice").orderBy("__ghost", F.desc_nulls_last(id_col), text_col)
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in [text_col, *extra]})
    return led.filter(F.col("__ghost") == 0).drop("__slice", "__ghost")


def exact_groups(docs: DataFrame, prints: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, canon_sha256, canonical_id) of each group of at least two rows with one canonical text.

    ``prints``: id_col and fingerprint of every row. Inside the bucket of a repeated fingerprint rows
    are grouped by their canonical bytes, so that a collision gives several groups; the partial
    aggregation keeps one copy of a text a task. ``canonical_id``: the least id.
    """
    repeated = stash(prints.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "repeated")
    ids = stash(prints.join(repeated, "fingerprint", "left_semi").select(F.col(id_col).alias("__id")).distinct(), "ids")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.join(small, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    canon = rows.select(F.col(id_col).alias("__id"), canonical(F.col(text_col)).alias("__canon")).groupBy("__canon").agg(F.min("__id").alias("canonical_id"), F.count("*").alias("__n"))
    named = canon.withColumn("fingerprint", fingerprint(F.col("__canon")))
    return named.join(repeated, "fingerprint", "left_semi").select("fingerprint", F.sha2(F.col("__canon").cast("binary"), 256).alias("canon_sha256"), "canonical_id")


def fingerprints_with_edits(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of ``docs`` and of edited texts: id, n_chars, edited_sha256, fingerprint, and likenesses.

    A null text is empty. The edited text has its last third (floor) replaced by the first as many
    code points of the next document by descending id. ``near_edited`` and ``near_next`` are 1 where
    the fingerprints agree and else 0: an exact digest knows no more. ``canonical_id``: the least id
    among documents with the same canonical bytes. Texts count whole, however long; repeated rows stay,
    ids that repeat are in order of their texts, columns of ``docs`` other than the two are not read,
    and an empty table gives none.
    """
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    led = with_next(base, "__text", {"fingerprint": fingerprint(canonical(F.col("__text")))}, id_col)
    n = F.length("__text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next___text"), F.lit(1), cut))
    led = led.select(id_col, n.alias("n_chars"), edited.alias("__edited"), "fingerprint", F.col("next_fingerprint"))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    out = led.withColumn("edited_fingerprint", fingerprint(canonical(F.col("__edited"))))
    out = out.withColumns({"near_edited": same("fingerprint", "edited_fingerprint"), "near_next": same("fingerprint", "next_fingerprint")})
    out = stash(out.select(id_col, "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "fingerprints")
    groups = stash(exact_groups(docs, out.select(id_col, "fingerprint"), text_col, id_col), "groups")
    apart = groups.groupBy("fingerprint").count().filter("count > 1").select("fingerprint")
    if not apart.isEmpty():  # a collision: these buckets go by their bytes
        ids = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("__canon")).withColumn("fingerprint", fingerprint(F.col("__canon"))).join(apart, "fingerprint", "left_semi")
        ids = ids.select(id_col, "fingerprint", F.sha2(F.col("__canon").cast("binary"), 256).alias("canon_sha256")).join(groups, ["fingerprint", "canon_sha256"]).select(id_col, "fingerprint", "canonical_id").distinct()
        single = groups.join(apart, "fingerprint", "left_anti").select("fingerprint", "canonical_id")
        known = out.join(apart, "fingerprint", "left_anti").join(single, "fingerprint", "left")
        out = known.unionByName(out.join(ids, [id_col, "fingerprint"]))
    else:
        out = out.join(groups.select("fingerprint", "canonical_id"), "fingerprint", "left")
    return out.withColumn("canonical_id", F.coalesce("canonical_id", id_col))
