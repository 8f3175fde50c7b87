"""A corpus pipeline over ``documents``: language, line dedup, near duplicates, mixing, encoding.

Null values in any column, empty and very long texts, repeated rows and ids, ties and empty tables go
through every stage; columns of the input other than those of ``documents`` are not read, whatever their
names. Null and empty texts leave with the first stage, which knows no language for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, language_id, line_templates, mixing, signature_tree
from lumenfold.session import discard, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose most likely language is less likely than this is rejected.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, and the similarity as a fraction.
WIDTH, NUM, DEN = 5, 80, 100
#: Rows of a batch between Spark and its Python workers: texts are long, and workers keep what they once held.
BATCH_ROWS = 1024
#: Rows of decisions up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one.

    Rejected are texts without a letter, texts that two languages explain about as well, and texts
    whose code length is strange to their language among texts of their size. Models and limits come
    from all documents.
    """
    _small_batches(spark)
    model = language_id.train(docs, most=None)
    named = stash(language_id.identify(docs.select(*COLUMNS), model), "named")
    limits = stash(language_id.spreads_of(named), "spreads")
    named = named.withColumn("size_class", language_id.size_class())
    known = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).join(_small(limits), ["lang_pred", "size_class"], "left")
    known = known.filter(F.col("most_bits").isNull() | (F.col("bits_per_byte") <= F.col("most_bits")))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no word is left go."""
    _small_batches(spark)
    cut = line_templates.drop_recurring(docs.select(*COLUMNS))
    left = cut.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, null last.

    Rows go by their texts: an id that repeats neither links texts nor removes any, and of rows that
    repeat both id and text one stays. Texts without words have no duplicates.
    """
    _small_batches(spark)
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__row"))
    found = stash(signature_tree.jaccard_components(keyed, WIDTH, NUM, DEN, keep=("__row",)).filter("n_shingles > 0"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    groups = found.groupBy("set_group").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("set_group", "first")
    crowd = stash(found.join(groups, "set_group").select("doc_id", "__row", (rank == F.col("first")).alias("stays")), "crowd")
    gone = stash(crowd.filter("not stays").select("doc_id", "__row").distinct(), "near_duplicates")
    twice = stash(crowd.filter("stays").groupBy("doc_id", "__row").count().filter("count > 1").select("doc_id", "__row"), "repeated_rows")
    discard(found, crowd)

    def same(table: DataFrame) -> tuple[DataFrame, Column]:
        other = table.toDF("__id", "__other")
        return _small(other), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__other"))

    left = keyed.join(*same(gone), "left_anti")
    if twice.isEmpty():
        return left.select(*COLUMNS)
    one = left.join(*same(twice), "left_semi").groupBy("doc_id", "__row").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return left.join(*same(twice), "left_anti").select(*COLUMNS).unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.with_copies(docs.select(*COLUMNS)).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to; a null text has none of either."""
    _small_batches(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express the language models, the signature trees and the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and reread by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = stash(made, name)
            discard(docs)
        docs = made
    return docs
