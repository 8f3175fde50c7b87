"""Held-out accuracy of the trained operators, and their odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import language_id, quality_model, queries


def test_language_accuracy_on_held_out_rows(spark, sf, docs):
    found = queries.op2_ppm_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, all_ = found.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).first()
    assert right >= 0.97 * all_


def test_code_lengths_are_those_of_a_plain_model():
    """The table of code lengths against PPM (method C, with exclusion) computed byte by byte."""
    train, text = b"abracadabra abracadabra banana", b"abrabanana cab"
    padded = [256] * 3 + list(train)
    grams: dict[int, int] = {}
    for i in range(3, len(padded)):
        code = 0
        for k in range(3, -1, -1):
            code = code * 257 + padded[i - k]
        grams[code] = grams.get(code, 0) + 1
    model = language_id.build_model(["x"], [np.array(sorted(grams))], [np.array([grams[g] for g in sorted(grams)], float)])
    counts: dict[tuple, dict[int, int]] = {}
    for i in range(3, len(padded)):
        for k in range(4):
            counts.setdefault(tuple(padded[i - k : i]), {}).setdefault(padded[i], 0)
            counts[tuple(padded[i - k : i])][padded[i]] += 1
    totals = {c: sum(v.values()) for c, v in counts.items()}
    symbols = len(set(train)) + 1

    def probability(context, byte):
        p, out = 1.0, set()
        while True:
            if len(context) == 0 or totals.get(context, 0) >= 2:
                free = {b: n for b, n in counts.get(context, {}).items() if b not in out}
                total, kinds = sum(free.values()), len(free)
                if byte in free:
                    return p * free[byte] / (total + kinds)
                if kinds:
                    p *= kinds / (total + kinds)
                out |= set(free)
            if not context:
                return p / (symbols - len(out))
            context = context[1:]

    history, want = [256] * 3, 0.0
    for b in text:
        want -= np.log2(probability(tuple(history[-3:]), b))
        history.append(b)
    assert model.code_lengths(pa.array([text.decode()]))[0, 0] == pytest.approx(want, rel=1e-5)


def test_code_lengths_do_not_depend_on_blocks(monkeypatch, spark, docs):
    model = language_id.train(docs)
    texts = pa.array([r.text for r in docs.select("text").limit(20).collect()] + ["", None, "x"])
    whole = model.code_lengths(texts)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert np.allclose(whole, model.code_lengths(texts))


def test_parts_of_a_model_agree_with_the_whole(docs):
    """Trees sent one by one give the verdicts of all at once; every language has a tree."""
    model = language_id.train(docs)
    assert model.languages == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    whole = {r.doc_id: r for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    parts = language_id.identify(docs, model, keep=["doc_id"], most=1).collect()
    assert len(parts) == len(whole) and len(model.parts(1)) == len(model.languages)
    for r in parts:
        want = whole[r.doc_id]
        assert r.lang_pred == want.lang_pred and r.score == pytest.approx(want.score, abs=1e-9) and r.bits_per_byte == pytest.approx(want.bits_per_byte)


def test_strange_texts_pass_the_spread_of_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    limits = language_id.spreads(docs, model)
    strange = spark.createDataFrame([(-i, "".join(chr(0x4E00 + (i * 37 + k * k) % 900) for k in range(300)), "en") for i in range(1, 6)], "doc_id long, text string, lang string")
    found = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(strange), model).withColumn("size_class", language_id.size_class())
    gone = found.join(limits, ["lang_pred", "size_class"]).filter("bits_per_byte > most_bits")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    assert {-1, -2, -3, -4, -5} <= {r.doc_id for r in gone.collect()} and gone.join(labels, "doc_id").isEmpty()
    assert gone.count() <= 5 + 0.01 * docs.count()


def test_language_odd_rows(odd, empty, docs):
    model = language_id.train(docs)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == 9
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr"}
    assert language_id.identify(empty, model).count() == 0
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_quality_accuracy_on_held_out_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op3_ftrl_quality(spark, sf).join(labels, "doc_id").filter("held_out")
    right, all_ = found.agg(F.count_if(F.expr("quality = predicted")), F.count("*")).first()
    assert right >= 0.9 * all_


def test_quality_accuracy_on_a_larger_table(spark):
    """The same on ten times the rows, and the share of each label that is told."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op3_ftrl_quality(spark, sf).join(labels, "doc_id").filter("held_out")
    good, told, bad, caught = found.agg(F.count_if(F.expr("quality = 1")), F.count_if(F.expr("quality = 1 and predicted = 1")), F.count_if(F.expr("quality = 0")), F.count_if(F.expr("quality = 0 and predicted = 0"))).first()
    assert told >= 0.95 * good and caught >= 0.9 * bad


def test_weights_do_not_depend_on_partitions(spark, docs, sf, monkeypatch):
    """Shards of some rows, dealt over 1, 4 and 211 tasks, teach the same weights, and those of a plain mean over shards."""
    monkeypatch.setattr(quality_model, "SHARD_ROWS", 20)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plain = type(docs).repartition
    found = []
    for n in (1, 4, 211):
        monkeypatch.setattr(type(docs), "repartition", lambda self, k, *cols, n=n: plain(self, n, *cols))
        found.append(quality_model.train(docs, labels, "quality"))
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2])
    monkeypatch.undo()
    monkeypatch.setattr(quality_model, "SHARD_ROWS", 20)
    order = F.xxhash64(F.lit("quality sample"), "doc_id")
    shards = round(labels.count() / 20)
    rows = docs.join(labels, "doc_id").select("text", "quality", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).alias("shard"), order.alias("order")).filter("text is not null").collect()
    want, total = np.zeros(quality_model.BUCKETS + 1), 0
    for shard in range(shards):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: (r.order, r.text))
        examples = list(quality_model.examples_of(pa.array([r.text for r in own], pa.string()), np.array([r.quality for r in own], float)))
        if examples:
            want += quality_model.fit(examples) * len(examples)
            total += len(examples)
    assert np.allclose(found[0], want / total, atol=1e-5)


def test_updates_are_those_of_plain_ftrl():
    """Weights of a shard against FTRL-proximal coordinate by coordinate in plain Python."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(["a", "b", "c1", "Dd", "!"], 12)) for _ in range(15)]
    examples = list(quality_model.examples_of(pa.array(texts), rnd.integers(0, 2, 15).astype(float)))
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == quality_model.BUCKETS else quality_model.L1
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((quality_model.BETA + n.get(i, 0.0) ** 0.5) / quality_model.ALPHA + quality_model.L2)

    for _ in range(quality_model.EPOCHS):
        for at, value, label in examples:
            w = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + np.exp(-sum(w[int(i)] * v for i, v in zip(at, value, strict=True))))
            for i, v in zip(map(int, at), value, strict=True):
                g = (p - label) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality_model.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality_model.fit(examples)
    assert {int(i) for i in np.flatnonzero(got)} == {i for i in z if weight(i)} and all(np.isclose(got[i], weight(i)) for i in z)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    weights = quality_model.train(odd, labels, "quality")
    rows = quality_model.score(odd, weights).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    bare = 1 / (1 + np.exp(-float(weights[-1])))
    assert all(r.score == pytest.approx(bare, rel=1e-5) for r in rows if not (r.text or "").strip())
    assert quality_model.score(empty, weights).count() == 0
    assert not quality_model.train(empty, labels.limit(0), "quality").any()


def test_the_pipeline_learns_languages_from_all_documents(spark, sf, docs, monkeypatch):
    import corpus_pipeline
    from lumenfold.llm import language_id as L

    read = []
    plain = L.sample_of

    def noted(*args):
        read.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(L, "sample_of", noted)
    many = docs.crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    corpus_pipeline.language_stage(spark, many, sf)
    assert read == [many.filter("lang IS NOT NULL AND text IS NOT NULL").count()]
