"""Periodic runs, shards and centroids against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from oracle import difference

from lumenfold.llm import centroids, queries, runs, shards

BLANK = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_runs(words):
    """By every period: maximal stretches of equal words so far apart; each with its least period only."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rnd):
    """Words of few kinds with planted periods, nested ones too."""
    out = []
    while len(out) < rnd.choice([5, 40, 300]):
        unit = [rnd.choice("ab") for _ in range(rnd.randrange(1, 14))]
        if rnd.random() < 0.3:
            unit = (unit * 5)[: rnd.randrange(1, 5 * len(unit) + 1)]
        n = rnd.randrange(1, 7) * len(unit) + rnd.randrange(len(unit))
        out += (unit * 8)[:n]
    return out


def test_runs_are_those_of_a_plain_search():
    rnd = random.Random(5)
    some = [random_words(rnd) for _ in range(400)]
    some += [list("a" * 200), list("ab" * 100), [], list("aaaaa"), list("aaaaaa"), ["x", *"abc" * 4], list("abab" * 2), list(("aab" * 5 + "b") * 6), [bin(i).count("1") % 2 for i in range(4096)]]
    hashed = [np.array([zlib.crc32(str(w).encode()) for w in d], np.uint64) for d in some]
    for step in (some[:1], some[:60], some[60:]):
        mine = [hashed[i] for i in (range(len(step)) if step is not some[60:] and step[0] is some[0] else range(60, len(some)))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in mine])])
        got = runs.find_runs(np.concatenate(mine), first)
        want = [(s + int(at), n, q) for d, at in zip(step, first, strict=False) for s, n, q in plain_runs(d)]
        assert got.tolist() == [list(r) for r in sorted(want)]


def test_windows_of_a_cancelling_sequence_differ():
    """Thue-Morse words, on which sums of powers modulo 2 ** 64 collide."""
    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], np.uint64)
    w = runs.Windows(bits).of(11)
    assert len(set(w.tolist())) == len({tuple(bits[i : i + 2048].tolist()) for i in range(len(bits) - 2047)})


def op11_rows(rows):
    out = {}
    for doc_id, text in rows:
        words = plain_words(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(found), *best, None if not found else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_op11_on_the_given_documents(spark, sf, docs):
    short = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 6000}
    want = op11_rows(short.items())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_dyadic_runs(spark, sf).collect()}
    assert len(got) == docs.count() and {i: got[i] for i in want} == want and sum(w[0] > 0 for w in want.values()) > 5


def test_runs_on_odd_rows(spark, odd, empty):
    clash = odd.selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS n_words", "3 AS __words")
    got = runs.collapse_runs(clash).collect()
    assert len(got) == 9
    for r in got:
        words = plain_words(r.text)
        want = plain_runs(words) if len(words) < 1000 else [(0, len(words) - 1, 5)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
    assert {r.collapsed for r in got if not plain_words(r.text)} == {""}
    assert {r.collapsed for r in got if r.doc_id == 4} == {"lorem ipsum dolor sit amet end"}
    assert runs.collapse_runs(empty).count() == 0


def shard_rows(table, **args):
    return shards.shards_by_bytes(table, **args).collect()


def assert_law(rows, n, texts):
    """Sizes and counts as stated, slots without gaps, and shards whose sizes miss the equal share by two halves of a row at most."""
    size = [len((t or "").encode()) + 8 for t in texts]
    assert sorted(r.size for r in rows) == sorted(size)
    share, most = sum(size) / n, max(size)
    for k in range(n):
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and abs(sum(r.size for r in own) - share) <= most
    assert {r.shard for r in rows} <= set(range(n))


def test_shards_are_equal_contiguous_and_whole(spark, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = shard_rows(docs)
    assert_law(rows, 24, texts.values())
    order = sorted(texts, key=lambda i: (hashlib.md5((texts[i] or "").encode()).digest(), hashlib.md5(str(i).encode()).hexdigest()))
    run, total, want = 0, sum(len((t or "").encode()) + 8 for t in texts.values()), {}
    for i in order:
        size = len((texts[i] or "").encode()) + 8
        want[i] = (2 * run + size) * 24 // (2 * total)
        run += size
    heads = {}
    for i in order:
        heads.setdefault(want[i], order.index(i))
    for r in rows:
        assert (r.shard, r.slot, r.text_crc32) == (want[r.doc_id], order.index(r.doc_id) - heads[want[r.doc_id]], zlib.crc32((texts[r.doc_id] or "").encode()))


@pytest.mark.parametrize("part_rows", [50, 200_000])
def test_shards_of_repeated_rows(spark, part_rows, monkeypatch):
    """A third of all rows equal in id and text, and more of one text under other ids."""
    monkeypatch.setattr(shards, "PART_ROWS", part_rows)
    rows = [(None, "a copy of the same text")] * 400 + [(i, "another text that many have") for i in range(300)] + [(i, f"text {i} " + "x" * (i % 90)) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = shard_rows(table, shards=7)
    assert len(found) == len(rows)
    assert_law(found, 7, [t for _, t in rows])
    groups = {}
    for r in found:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(max(s) - min(s) + 1 == len(s) for s in groups.values())


def test_shards_on_odd_rows(odd, empty):
    clash = odd.selectExpr("*", "1 AS size", "2 AS shard", "3 AS __id", "4 AS __key")
    assert_law(shard_rows(clash, shards=3), 3, [r.text for r in odd.collect()])
    assert len(shard_rows(odd, shards=1000)) == 9 and shards.shards_by_bytes(empty).count() == 0


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v) == 64]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, one, strict=True)), j) for j, one in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            c[j] = [sum(p) // len(own) for p in zip(*own, strict=True)] if own else c[j]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=str)


def test_op13_same_rows_as_sql(spark, sf):
    assert difference(queries.op13_displacement_kmeans(spark, sf), queries.ORACLE_SQL["op13_displacement_kmeans"], sf) == ""


def test_clusters_of_a_plain_version(spark):
    """Clouds that move for rounds, ties, copies, empty clusters, odd vectors, and columns with clashing names."""
    rnd = np.random.default_rng(7)
    mid = rnd.normal(size=(9, 64)) * 0.4
    rows = [(i, (mid[i % 9] + rnd.normal(size=64) * (0.02 + 0.1 * (i % 3))).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(7, rows[5][1]), (7, rows[6][1]), (None, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [float("nan")] + [0.5] * 63), (2004, [float("inf")] * 64), (2005, []), (2006, [-0.0] * 64), (2007, [1000.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS __id")
    for k in (1, 12, 40):
        got = centroids.centroid_clusters(table.repartition(3), k=k)
        seen = got.collect()
        assert sorted((tuple(r)[:6] for r in seen), key=str) == plain_clusters(rows, k, 5)
    # Most distances are spared in the rounds after the first.
    assert sum(r.evaluated for r in seen) < 0.6 * 40 * 6 * len(seen)


def test_clusters_of_few_and_of_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r)[:6] for r in centroids.centroid_clusters(table).collect()), key=str) == plain_clusters(rows, 40, 5)
    none = centroids.centroid_clusters(table.limit(0))
    assert none.count() == 0 and none.columns == centroids.centroid_clusters(table).columns
    far = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [6000.0] * 64), (4, [1e5] * 64)], "vec_id long, embedding array<float>")
    assert [r.distance for r in centroids.centroid_clusters(far).collect()] == [0] * 4


def test_bounds_by_total_displacement_are_tighter():
    """A centroid that comes back: the sum of its moves is large, the norm of their sum none, and no distance is evaluated."""
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-5, 6, (40, 64)), rnd.integers(95, 106, (40, 64))])
    c = np.stack([x[:40].mean(0), x[40:].mean(0)]).astype(np.int64)
    state = centroids.Bounds.of_round_0(x, c)
    away = c + np.array([[200], [200]])
    assert not state.advance(x, np.stack([c, away, c])).any() and (state.cluster == np.repeat([0, 1], 40)).all()
