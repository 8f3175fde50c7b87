"""Statistics, mixing, digests and personal data against plain versions."""

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from oracle import difference
from pyspark.sql import functions as F

from lumenfold.llm import digest, disclosure, mixing, queries, robust_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_statistics_are_exact(docs, odd):
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        joined = robust_stats.statistics(table.withColumn("copy", F.col("text")))
        for r in joined.collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r["copy"] or "")


def test_rules_keep_clean_and_reject_marked_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op1_mcd_quality(spark, sf).join(labels, "doc_id").filter("not base_failed")
    good, kept, bad, gone = found.agg(F.count_if(F.expr("quality = 1")), F.count_if(F.expr("quality = 1 and kept")), F.count_if(F.expr("quality = 0")), F.count_if(F.expr("quality = 0 and not kept"))).first()
    assert kept == good and gone >= 0.8 * bad


def test_rules_on_odd_rows(odd, empty):
    rows = robust_stats.quality_rules(odd).collect()
    assert len(rows) == 9 and not any(r.kept for r in rows if r.n_words < 20)
    assert robust_stats.quality_rules(empty).count() == 0
    clash = odd.selectExpr("*", "1 AS n_words", "'x' AS f_words", "2 AS distance", "3 AS start", "4 AS m0", "5 AS logdet", "6 AS caps", "7 AS base_failed")
    got = robust_stats.quality_rules(clash)
    assert got.count() == 9 and len(set(got.columns)) == len(got.columns) and {r.n_words for r in got.collect()} != {1} and {r.start for r in got.collect()} == {3}


def test_concentration_finds_planted_outliers(spark):
    rows = [(i, (i * 37 % 101) / 50 + 5, (i * 53 % 97) / 100 + 1.5, 0.0, 0.0, 0.0, (i * 29 % 89) / 200, 0.0, "en", "a") for i in range(400)] + [(1000 + i, 6.0, 1.9, 3.0, 0.0, 0.0, 0.2, 0.0, "en", "a") for i in range(60)]
    table = spark.createDataFrame(rows, ["doc_id", *robust_stats.FEATURES, "lang", "source"])
    found = {r.doc_id: r.distance for r in robust_stats.outliers(table).collect()}
    assert max(found[i] for i in range(400)) < robust_stats.CUTOFF < min(found[1000 + i] for i in range(60))


def plain_distances(x):
    """Distances from the same regularised MCD with sorted distances instead of grids, in NumPy."""
    floor = np.diag(np.square(robust_stats.FLOORS))
    mid = np.median(x, 0)
    scale = np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, robust_stats.FLOORS)
    z = (x - mid) / scale
    size = (z**2).sum(1)
    sign = np.einsum("ni,nj->ij", z / np.maximum(size, 1e-300)[:, None], z) / len(x) * x.shape[1]
    bent = np.tanh(z).T @ np.tanh(z) / len(x)
    outer = np.outer(scale, scale)

    def distances(m, s):
        return np.sqrt(np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m))

    def step(m, s):
        d = distances(m, s)
        inside = x[d <= np.sort(d)[int(np.ceil(robust_stats.COVERAGE * len(x))) - 1]]
        return inside.mean(0), np.cov(inside.T, bias=True) / robust_stats.CONSISTENCY + floor

    found = []
    for s in (np.diag(scale**2), sign * outer + floor, bent * outer + floor):
        m = mid
        for _ in range(12):
            m, s = step(m, s)
        found.append((np.linalg.slogdet(s)[1], distances(m, s)))
    return min(found, key=lambda f: f[0])


def test_distances_are_those_of_the_least_determinant(spark):
    """Two clouds of other shape and a tilted bulk, in two groups: distances near a plain version's, and the same verdicts."""
    rnd = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 500), ("b", 300)):
        bulk = rnd.normal(size=(n, 7)) @ (np.eye(7) + 0.6 * np.eye(7, k=1)) * 0.5
        far = rnd.normal(size=(n // 8, 7)) * 0.1 + np.array([4.0, -3.0, 3.0, 0, 0, 2.0, 0])
        rows += [(f"{g}{i}", *map(float, v), "en", g) for i, v in enumerate(np.concatenate([bulk, far]))]
    table = spark.createDataFrame(rows, ["doc_id", *robust_stats.FEATURES, "lang", "source"])
    got = {r.doc_id: r.distance for r in robust_stats.outliers(table).collect()}
    for g in "ab":
        own = [r for r in rows if r[-1] == g]
        _, want = plain_distances(np.array([r[1:8] for r in own]))
        have = np.array([got[r[0]] for r in own])
        assert np.abs(have / want - 1).max() < 0.05
        sure = np.abs(want - robust_stats.CUTOFF) > 0.3
        assert ((have <= robust_stats.CUTOFF) == (want <= robust_stats.CUTOFF))[sure].all() and (want > robust_stats.CUTOFF).any()


def test_mix_equals_sql(spark, sf):
    for name in ("op4_pareto_mix", "op4_pareto_mix_weighted"):
        assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""


def test_mix_holds_its_promises(docs):
    rows = mixing.pareto_mix(docs).collect()
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.pareto_mix(docs).collect()))


def test_mix_with_unequal_weights(docs):
    weight = F.when(F.col("doc_id") % 40 < 20, 3.0).otherwise(1.0)
    rows = mixing.pareto_mix(docs, weight=weight, share=0.4).collect()
    even, odd = ([r.copies for r in rows if r.doc_id % 40 // 20 == k] for k in (0, 1))
    assert sum(even) / len(even) > sum(odd) / len(odd)


def test_copies_told_row_by_row_are_those_of_the_mix(docs, odd):
    for table, weight in ((docs, None), (docs, F.expr("1 + pmod(doc_id, 4)")), (odd, None)):
        want = sorted((r.doc_id or -1, r["size"], r.copies) for r in mixing.pareto_mix(table, weight=weight).collect())
        got = mixing.with_copies(table.withColumn("size", F.lit("x")), weight=weight)
        assert sorted((r.doc_id or -1, len(WORD.findall(r.text or "")), r.copies) for r in got.collect()) == want


def test_mix_of_odd_rows(odd, empty):
    assert mixing.with_copies(empty).count() == 0
    rows = mixing.pareto_mix(odd).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r.doc_id in (2, 3, 5)} == {0}
    assert mixing.pareto_mix(empty).count() == 0


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for i, (k, text) in enumerate(rows):
        cut = len(text) // 3
        yield k, text, text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut]


def test_digests_of_texts_and_edits(monkeypatch, docs, odd):
    for rows_a_slice in (16, 4096):
        monkeypatch.setattr(digest, "SLICE_ROWS", rows_a_slice)
        for table in (docs, odd):
            rows = [(r.doc_id, r.text or "") for r in table.collect()]
            want = Counter((k, len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e in edited(rows))
            got = digest.fingerprints_with_edits(table).collect()
            assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
            assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) for r in got)


def test_canonical_texts(spark, empty):
    groups = [["Café  ﬁn ", "CAFÉ fin", "café\tﬁn"], ["Straße", "STRASSE"], ["Ａｂ", "ab"], [None, "", " \n"], ["other"]]
    rows = [(i * 10 + k, t) for i, g in enumerate(groups) for k, t in enumerate(g)]
    got = {r.doc_id: r for r in digest.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, g in enumerate(groups):
        assert {got[i * 10 + k].canonical_id for k in range(len(g))} == {i * 10}
    assert len({got[i * 10].fingerprint for i in range(len(groups))}) == len(groups)
    assert digest.fingerprints_with_edits(empty).count() == 0


def test_copies_in_every_script_share_a_digest(spark):
    """Jamo, kana with voicing marks, Vietnamese with dot below last, marks out of order, and forms of several characters."""
    texts = ["한국어 텍스트", "ガギグ パピプ", "Việt Nam ệ Ộ ự", "q\u0307\u0323 \U0001d15e", "㌔ ㈱ ½ ﷺ Ǆ", "\u0958 \u0f73 ΐ"]
    forms = [lambda t, f=f: unicodedata.normalize(f, t) for f in ("NFC", "NFD", "NFKC", "NFKD")]
    groups = [{t, *(form(t) for form in forms)} for t in texts]
    groups[1].add("ｶﾞｷﾞｸﾞ ﾊﾟﾋﾟﾌﾟ")
    groups[2].add("Vi\u00ea\u0323t Nam \u00ea\u0323 \u00d4\u0323 \u01b0\u0323")
    rows = [(i * 100 + k, t) for i, g in enumerate(groups) for k, t in enumerate(sorted(g))]
    got = {r.doc_id: r for r in digest.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.canonical_id == k // 100 * 100 for k, r in got.items()) and len({r.fingerprint for r in got.values()}) == len(groups)


def test_canonical_form_of_every_code_point(spark):
    """Against Python's NFKC and case folding, for every assigned code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    table = spark.createDataFrame(pd.DataFrame({"c": points, "t": [f"a{chr(c)}b" for c in points]}))
    got = table.select("c", digest.canonical(F.col("t")).alias("t")).toPandas()
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    spaces = re.compile("[\\s\x1c-\x1f\x85]+")
    odd = [hex(c) for c, t in zip(got.c, got.t, strict=True) if spaces.sub(" ", nfkc(nfkc(f"a{chr(c)}b").casefold())).strip(" ") != t]
    assert not odd


def test_colliding_fingerprints_are_told_apart_by_bytes(monkeypatch, spark):
    monkeypatch.setattr(digest, "fingerprint", lambda canon: F.lit("0" * 32))
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A "), (4, "c"), (5, "b")], "doc_id long, text string")
    got = {r.doc_id: r.canonical_id for r in digest.fingerprints_with_edits(table).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: re.findall("[0-9]", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and disclosure.luhn("".join(digits(s))),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans(spark, sf, docs, odd):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op8_disclosure(spark, sf).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in PATTERNS)
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    by = Counter((r.doc_id, len(r.base)) for r in disclosure.find_personal(odd).collect())
    assert by[(6, 2)] == 1 and sum(by.values()) == 9


def test_secrets_are_spans_and_words_are_not(spark):
    key = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    texts = [f'é token = "{key}" here', "see /2024/11/how-to-write-a-very-long-title-2024 or aaaaaaaaaaaaaaaaaaaaaaaaaaa", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", f"x{key}@mail.example.com"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = disclosure.find_personal(table)
    got = {r.doc_id: [(s["kind"], texts[r.doc_id][s["start"] : s["end"]]) for s in r.secrets] for r in found.collect()}
    assert got == {0: [("secret", key)], 1: [], 2: [], 3: []}
    assert {r.doc_id: r.text for r in disclosure.sanitise(table, found).collect()}[0] == 'é token = "[SECRET]" here'


def test_disclosing_terms_are_found_and_removed(spark, empty):
    rows = [(i, f"ask zebulon kwarx at bob@x.com about case {i} {'foo ' * i}") for i in range(5)] + [(100 + i, f"nothing about case {i} to ask at all") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.find_personal(table, least=3)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(table, found).collect()}
    assert all("zebulon" not in clean[i] and "kwarx" not in clean[i] and "bob@x.com" not in clean[i] and "about" in clean[i] for i in range(5))
    assert all(clean[k] == t for k, t in rows if k >= 100)
    assert disclosure.find_personal(empty).count() == 0


def test_disclosing_terms_anywhere_in_any_text(spark):
    """A term far from the entity, at other places of the text and in texts without the entity; é and an emoji before it."""
    far = " ".join(f"w{'abcdefghij'[k % 10]}x" for k in range(40))
    rows = [(i, f"é\U0001f600 Zebulon {'wrote ' * (i + 1)}\n{far} bob@x.com\n{far} {'zebulon ' * 2}") for i in range(4)]
    rows += [(50, f"zebulon stayed. {far}"), *[(100 + i, f"wrote nothing {far} {i}") for i in range(80)]]
    found = {r.doc_id: r for r in disclosure.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), disclosed=0.8).collect()}
    for k, text in rows:
        want = [m.span() for m in re.finditer("zebulon", text.lower())]
        assert [(s["start"], s["end"]) for s in found[k].terms] == want


def test_disclosing_terms_of_the_given_documents(spark):
    """Whole texts of sf0.01: the word before every secret gives secrets away, and no text without personal data has a term span."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = disclosure.find_personal(table).join(table.select("doc_id", "text"), "doc_id").collect()
    terms = [(r.text[s.start : s.end].lower(), bool(r.base or r.secrets)) for r in found for s in r.terms]
    assert len(terms) >= 10 and {w for w, _ in terms} == {"token"} and sum(has for _, has in terms) >= 0.95 * len(terms)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(table, disclosure.find_personal(table)).filter("text like '%[SECRET]%'").collect()}
    assert clean and not any("token" in t for t in clean.values())


def test_terms_of_planted_kinds_names_and_domains(spark):
    """A phrase before every address, a name of an address, and a word of its domain's texts; frequent words and chance words stay."""
    rows = [(i, f"common words number {'abcdefghij'[i % 10] * 5} stand here and see about things of") for i in range(300)]
    rows += [(1000 + i, f"common words, kontaktperson: user{i}.x@site{i}.org here chance{'xyz'[i % 3] * 3}{'abcdefghijkl'[i] * 4}") for i in range(12)]
    rows += [(2000 + i, f"see rosalind.{i}@big.net about rosalind and common things of {'klm'[i % 3] * 4}{'abcdef'[i] * 3}") for i in range(6)]
    rows += [(3000, "rosalind alone, and common words"), (3001, "kontaktperson without an address")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS terms", "3 AS secrets", "4 AS __row")
    found = {r.doc_id: r for r in disclosure.find_personal(table, disclosed=0.8).collect()}
    assert found[1003].base[0].kind == "email" and len(found) == len(rows)
    words = {i: {dict(rows)[i][s.start : s.end] for s in r.terms} for i, r in found.items()}
    assert words[3000] == {"rosalind"} and words[3001] == {"kontaktperson"} and words[1003] >= {"kontaktperson"} and words[2000] >= {"rosalind"}
    assert not any(words[i] for i in range(300)) and not any({"common", "words", "here", "and"} & w for w in words.values())


def test_copies_of_rows_that_are_all_alike(spark):
    """Hundreds of rows equal in id, text and source: the stage takes as many of them as the query, and targets hold."""
    rows = [(None, "six words that are all alike", "a")] * 300 + [(7, "three words here", None)] * 1500 + [(i, "a few words " * (i % 9 + 1), "b") for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    plain = mixing.pareto_mix(table).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    staged = mixing.with_copies(table)
    got = {r.source: r.taken for r in staged.withColumn("size", mixing.word_count("text")).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    assert staged.count() == len(rows) and got == {r.source: r.taken for r in plain}
    assert all(abs(r.taken - r.target) <= 30 for r in plain)
