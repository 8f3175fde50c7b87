"""The registered queries of the subpackage, and their SQL for a second engine where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, centroids, digest, disclosure, language_id, line_templates, mixing, quality_model, robust_stats, runs, shards, signature_tree, token_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``: the folds of the trained operators."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust_stats.quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out)
    weights = quality_model.train(docs, labels, "quality")
    return quality_model.score(docs.withColumn("held_out", held_out), weights, keep=["doc_id", "held_out"])


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_pareto_mix_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents that differ in weight, so that inclusion probabilities are unequal."""
    found = mixing.pareto_mix(documents(spark, sf_dir), weight=F.expr("1 + pmod(doc_id, 4)"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: @WEIGHT@: a document's weight.
OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, (@WEIGHT@)::DOUBLE AS weight FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * weight) AS weighted FROM base GROUP BY source
), numbered AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap FROM totals
), run AS (
  SELECT *, cap / w AS filled, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM numbered
), level AS (
  SELECT (budget - before) / open AS level FROM run WHERE (budget - before) / open <= filled ORDER BY filled, level LIMIT 1
), aims AS (
  SELECT r.source, r.source_size, r.weighted, coalesce(least(r.w * l.level, r.cap), r.cap) AS target FROM run r LEFT JOIN level l ON true
), drawn AS (
  SELECT b.doc_id, b.source, b.size, a.source_size, a.target,
         CASE WHEN a.weighted > 0 THEN least(2.0::DOUBLE, a.target / a.weighted * b.weight) ELSE 0.0::DOUBLE END AS expected,
         (('0x' || substr(md5('17:' || b.doc_id || ':' || b.size), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM base b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source
), sure AS (
  SELECT *, floor(expected + 1e-9::DOUBLE) AS sure, greatest(0.0::DOUBLE, expected - floor(expected + 1e-9::DOUBLE)) AS rest FROM drawn
), ranked AS (
  SELECT *, CASE WHEN rest > 1e-9::DOUBLE THEN (u / (1 - u)) / (rest / (1 - rest)) END AS odds,
         target - sum(size * sure) OVER (PARTITION BY source) AS gap FROM sure
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM ranked
)
SELECT doc_id, size, source_size, target,
       ((sure + CASE WHEN odds IS NOT NULL AND upto + size / 2 <= gap THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_components(documents(spark, sf_dir), width=3, num=90, den=100)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(documents(spark, sf_dir).select("doc_id", "text"))


def op7_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints_with_edits(documents(spark, sf_dir).select("doc_id", "text"))


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_personal(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(disclosure.span_text("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, disclosure.KINDS), base, disclosure.span_text(F.concat("base", "secrets", "terms")).alias("spans"), (F.size("base") + F.size("secrets")).cast("long").alias("n_personal"), F.size("terms").cast("long").alias("n_terms"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which, of a tenth of the ids, the words from one on repeat with a period; ids are long."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, g = F.size("__words").cast("long"), F.floor(F.col("__h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    # Lists of one, so that words, start and period are computed once and not for every word.
    held = F.array(F.struct(F.col("__words").alias("w"), a.alias("a"), p.alias("p")))
    place = lambda t, i: F.when(i < t["a"], i).otherwise(t["a"] + F.pmod(i - t["a"], t["p"]))
    again = F.element_at(F.transform(held, lambda t: F.array_join(F.transform(t["w"], lambda _, i: F.get(t["w"], place(t, i).cast("int"))), " ")), 1)
    marked = docs.withColumns({"__h": h, "__words": words})
    return marked.withColumn("text", F.when(F.size("__words") > 0, again).otherwise(F.col("text"))).drop("__h", "__words")


def op11_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(with_planted_periods(documents(spark, sf_dir).select("doc_id", "text")), keep=["doc_id"])
    best = runs.most_periodic("runs")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), runs.run_text("runs").alias("listed"), "collapsed")
    milli = F.expr("1000L * best.length div best.period").alias("exponent_milli")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, sha("listed")("runs_sha256"), sha("collapsed")("collapsed_sha256"))


def op12_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shards_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_displacement_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).drop("evaluated")


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out: distances by components, the nearest centroid, the floors of the means."""
    nearest = """d@T@ AS MATERIALIZED (
  SELECT v.r, c.j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c@T@ c ON v.i = c.i GROUP BY v.r, c.j
), a@T@ AS MATERIALIZED (
  SELECT r, j, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, j) AS place FROM d@T@) WHERE place = 1
)"""
    means = """c@U@ AS MATERIALIZED (
  SELECT c.j, c.i, coalesce(m.x, c.x) AS x FROM c@T@ c LEFT JOIN (
    SELECT a.j, v.i, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x FROM a@T@ a JOIN v ON v.r = a.r GROUP BY a.j, v.i
  ) m ON m.j = c.j AND m.i = c.i
)"""
    steps = [nearest.replace("@T@", "0")]
    for t in range(rounds):
        steps += [means.replace("@T@", str(t)).replace("@U@", str(t + 1)), nearest.replace("@T@", str(t + 1))]
    return rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT r, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, 65) t(i)
), first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {k}
), c0 AS MATERIALIZED (
  SELECT f.j, v.i, v.x FROM first f JOIN v ON v.r = f.r
), {", ".join(steps)}, named AS (
  SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j
)
SELECT k.vec_id, a.j::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, n.centroid_sha256
FROM a{rounds} a JOIN kept k ON k.r = a.r JOIN named n ON n.j = a.j
"""


QUERIES = {
    "op1_mcd_quality": op1_mcd_quality,
    "op2_ppm_language": op2_ppm_language,
    "op3_ftrl_quality": op3_ftrl_quality,
    "op4_pareto_mix": op4_pareto_mix,
    "op4_pareto_mix_weighted": op4_pareto_mix_weighted,
    "op5_signature_tree_join": op5_signature_tree_join,
    "op6_line_templates": op6_line_templates,
    "op7_exact_digest": op7_exact_digest,
    "op8_disclosure": op8_disclosure,
    "op9_token_counts": op9_token_counts,
    "op10_prefix_bpe": op10_prefix_bpe,
    "op11_dyadic_runs": op11_dyadic_runs,
    "op12_prefix_shards": op12_prefix_shards,
    "op13_displacement_kmeans": op13_displacement_kmeans,
}

ORACLE_SQL: dict[str, str] = {
    "op4_pareto_mix": OP4_SQL.replace("@WEIGHT@", "1"),
    "op4_pareto_mix_weighted": OP4_SQL.replace("@WEIGHT@", "1 + doc_id % 4"),
    "op13_displacement_kmeans": _op13_sql(),
}
