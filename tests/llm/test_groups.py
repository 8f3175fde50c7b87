"""Near duplicates, line templates and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import line_templates, queries, signature_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(rows, width, num, den):
    sets, up, seen = [(k, shingles(t, width)) for k, t in rows], {}, defaultdict(list)
    for k, _ in sets:
        up.setdefault(k, k)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (k, s) in enumerate(sets):
        shared = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                a, b = find(k), find(sets[j][0])
                up[max(a, b)] = min(a, b)
    return Counter((k, len(s), find(k)) for k, s in sets)


def components(table, *args, **kwargs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in signature_tree.jaccard_components(table, *args, **kwargs).collect())


def test_query_equals_plain_version(spark, sf, docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_signature_tree_join(spark, sf).collect())
    assert got == plain_components([(r.doc_id, r.text) for r in docs.collect()], 3, 90, 100)


@pytest.mark.parametrize(("width", "num", "group", "leaves"), [(5, 80, 512, 64), (2, 40, 3, 1000), (2, 40, 3, 1), (1, 50, 4, 1)])
def test_components_at_other_thresholds(monkeypatch, docs, width, num, group, leaves):
    monkeypatch.setattr(signature_tree, "LEAF_PAIRS", leaves)
    assert components(docs, width, num, 100, group_sets=group) == plain_components([(r.doc_id, r.text) for r in docs.collect()], width, num, 100)


def test_chains_of_near_copies(spark):
    """Random edits of one text, whose links form chains around the threshold, and short texts."""
    rnd, rows = random.Random(4), []
    base = [f"w{rnd.randint(0, 400)}" for _ in range(60)]
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(60)] = f"v{rnd.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7)))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (512, 16):
        assert components(table, 3, 80, 100, group_sets=group) == plain_components(rows, 3, 80, 100)


def test_component_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = components(odd)
    assert sum(got.values()) == 9
    assert got[(2, 0, 2)] == got[(3, 0, 3)] == got[(5, 0, 5)] == 1
    assert {c for k, _, c in got if k == 1} == {1} and len(rows) == 9
    assert signature_tree.jaccard_components(empty).count() == 0


def test_equal_parts_lose_no_link():
    """Every pair of random sets that links shares a key, for sizes and thresholds of all bands."""
    rnd = np.random.default_rng(1)
    for num in (50, 80, 90):
        t = signature_tree.Threshold(num, 100)
        for size in [1, 2, 3, 5, 8, 13, 40, 150]:
            for _ in range(30):
                x = rnd.integers(0, 2**63, size, dtype=np.uint64)
                y = x[: size - int(rnd.integers(0, max(1, size // 4)))]
                y = np.concatenate([y, rnd.integers(0, 2**63, int(rnd.integers(0, max(1, size // 6) + 1)), dtype=np.uint64)])
                a, b = np.unique(x), np.unique(y)
                if signature_tree.linked(a, b, t) and not np.array_equal(a, b):
                    owner, keys = signature_tree.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), t)
                    assert set(keys[owner == 0]) & set(keys[owner == 1])


def plain_lines(rows):
    """Templates of every leaf from its differing lines, and the rule of the operator, line by line."""
    found, leaves = [], defaultdict(set)
    for n, (k, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = tuple("#" if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if words:
                leaves[len(words), words[:2]].add(words)
                found.append((n, k if k is not None else 2**63 - 1, i, words))
    general = {}
    for lines in leaves.values():
        support = Counter((j, w) for words in lines for j, w in enumerate(words))
        for words in lines:
            n, by = len(words), [support[j, w] for j, w in enumerate(words)]
            least = -(-2 * n // 3)
            reached = sorted(by, reverse=True)[least - 1]
            kept = tuple(w if 2 * c >= max(reached, 4) else None for w, c in zip(words, by, strict=True))
            size = n - kept.count(None)
            if reached >= 2 and size < n and size >= max(line_templates.GENERAL_KEPT, least):
                general[words] = kept
    seen = defaultdict(set)
    for _, k, _, words in found:
        seen[words].add(k)
        if words in general:
            seen["general", general[words]].add(k)
    drop = defaultdict(set)
    for n, k, i, words in found:
        for key, shown in [(words, words)] + [(("general", general[w]), general[w]) for w in [words] if w in general]:
            if len(seen[key]) >= max(2, -(-line_templates.EVIDENCE // (len(shown) - shown.count(None)))) and k > min(seen[key]):
                drop[n].add(i)
    return [(k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[n]), len(drop[n])) for n, (k, t) in enumerate(rows)]


def cut_lines(table, **kwargs):
    return Counter((r.doc_id, r.text, r.n_dropped) for r in line_templates.drop_recurring(table, **kwargs).collect())


def test_line_templates_equal_plain_version(spark, sf, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in queries.op6_line_templates(spark, sf).collect()) == Counter(plain_lines(rows))
    clash = odd.selectExpr("*", "1 AS lines", "2 AS row", "3 AS doc", "4 AS __lines", "5 AS n_lines")
    assert cut_lines(clash) == Counter(plain_lines([(r.doc_id, r.text) for r in odd.collect()]))


@pytest.mark.parametrize(("leaf_tokens", "keys"), [(line_templates.LEAF_TOKENS, 1000), (0, 0)])
def test_templates_of_random_logs(spark, empty, leaf_tokens, keys):
    """Messages with fields of one or two words at any place, and prose; leaves merged in tasks and by joins."""
    rnd = random.Random(8)
    names = [f"{a}{b}" for a in ("al", "be", "ka", "mi", "zo") for b in ("na", "ric", "lo", "th", "x")]
    forms = ["user {} logged in from the {} office", "posted by {} in News", "the backup of {} to {} ended after {} minutes without an error", "posted by {} at noon on {} in the Sports pages"]
    rows = []
    for i in range(120):
        lines = [rnd.choice(forms).format(*(rnd.choice([*names, str(rnd.randint(0, 99))]) for _ in range(3))) for _ in range(rnd.randint(0, 3))]
        lines += [" ".join(rnd.choice(["the", "of", "posted", "by", *names]) for _ in range(rnd.randint(1, 9))) for _ in range(3)]
        rows.append((i, "\n".join(lines)))
    want = Counter(plain_lines(rows))
    assert sum(n * c for (_, _, n), c in want.items()) > 100
    assert cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), leaf_tokens=leaf_tokens, broadcast_keys=keys) == want
    assert line_templates.drop_recurring(empty, leaf_tokens=leaf_tokens, broadcast_keys=keys - 1).count() == 0


def test_variable_fields_at_any_place_meet_in_one_template(spark):
    """Words as fields, at places of any kind, in a line of five tokens too; other words of the leaf stay."""
    line = "user {} logged in from the old office with the key number {} and left again after the daily report"
    people = "Alice Boris Carla Dimas Edith Farid".split()
    rows = [(i, f"The words {' '.join(people[(i * k) % 7 % 6] for k in range(1, 7))} are its own.\n{line.format(f'id{i}', 'abcdefghij'[i])}\nPosted by {people[i]} in News") for i in range(6)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1]} | {i: rows[i][1].split("\n")[0] for i in range(1, 6)}


@pytest.mark.parametrize("keys", [1000, 0])
def test_documents_of_templates_count_once(spark, keys):
    """Six kept tokens recur in four documents: by one line alone, by several together, not by several lines of few documents."""
    forms = ["alpha beta gamma delta {} zeta eta", "one two three four {} six seven", "red green blue white {} black grey"]
    rows = [(i, forms[0].format("epsilon")) for i in range(9)] + [(9, forms[0].format("theta")), (10, forms[0].format("iota"))]
    rows += [(20 + i, forms[1].format(x)) for i, x in enumerate(["five", "nine", "ten", "eight"])]
    rows += [(30 + i, "\n".join(forms[2].format(x) for x in ("brown", "pink", "lilac"))) for i in range(3)]
    want = Counter(plain_lines(rows))
    assert {k for (k, _, n) in want if n} == {*range(1, 11), 21, 22, 23}
    for tokens in (line_templates.LEAF_TOKENS, 0):
        assert cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), leaf_tokens=tokens, broadcast_keys=keys) == want


def test_short_lines_that_recur_in_many_documents(spark):
    """Two tokens in 12 documents and one in 24 go from all but the first; in one document fewer they stay."""
    most = {"Read more": 12, "See also": 11, "Share": 24, "Print": 23}
    own = [" ".join(f"{'abcdefghijklmnopqrstuvwxyz'[i]}{x}" for x in ("ub", "ike", "ost", "arn", "ell")) for i in range(25)]
    rows = [(i, "\n".join([own[i]] + [line for line, n in most.items() if i < n])) for i in range(25)]
    got = {r.doc_id: r.text.split("\n")[1:] for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [x for x, n in most.items() if i < n and (i == 0 or x in ("See also", "Print"))] for i in range(25)}


def test_pipeline_stages_against_plain_versions(spark, sf, docs):
    """Each stage on its predecessor's rows: lines and near duplicates plainly, languages and mixing by their promises."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, sf).cache()
    assert known.columns == columns and known.count() >= 0.95 * docs.count()
    lines = stages["line_dedup"](spark, known, sf).cache()
    want = [(k, t, n) for k, t, n in plain_lines([(r.doc_id, r.text) for r in known.collect()]) if n == 0 or WORD.search(t)]
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((k, t) for k, t, _ in want) and lines.columns == columns
    single = stages["near_duplicates"](spark, lines, sf).cache()
    groups = plain_components([(r.doc_id, r.text) for r in lines.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, _, c in groups if k == c) and single.columns == columns
    mixed = stages["mixing"](spark, single, sf).cache()
    counts = Counter(r.doc_id for r in mixed.collect())
    assert max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in single.collect()} and mixed.columns == columns
    coded = stages["encoding"](spark, mixed, sf)
    assert Counter(r.doc_id for r in coded.collect()) == counts


def test_pipeline_on_odd_rows(spark, sf, odd, empty):
    """Nulls, empty and long texts, repeated rows and ids, and further columns, one stage after another."""
    for table in (odd, empty):
        docs = table.withColumn("n_chars", F.lit(1).cast("long")).selectExpr("*", "1 AS row", "2 AS lines", "3 AS size")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            rows = docs.collect()
            assert len(rows) <= 2 * n and (name == "encoding" or docs.columns == corpus_pipeline.COLUMNS), name
        assert table is odd or not rows


def test_near_duplicates_go_by_texts(spark, sf):
    """An id that repeats removes no other text; of repeated rows, and of copies without ids, one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(5, a), (5, b), (7, near), (9, b), (5, a), (None, c), (None, c), (11, ""), (12, ""), (None, None), (8, c + " x")]
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, table, sf).collect())
    assert got == Counter([(5, a), (5, b), (8, c + " x"), (11, ""), (12, ""), (None, None)])


def test_run_applies_all_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(len(r.token_ids) == 4 * r.n_tokens for r in rows)
