"""Exact Jaccard links between documents by signature trees, and the groups that they form.

A document's set is that of its word shingles. The tree's root sends sets to candidate groups without
losing a link: sets of similar size are cut into so many parts of the hash space that two linked ones
must agree in a whole part with something in it, and sets with a part in common are in one group. Inside a
group a tree of nodes holds OR-combined token bitmaps and size ranges. Pairs of nodes are traversed
together; a pair whose largest possible overlap is too small for a link is left, as is one whose
sets are known to be in one component; what remains is decided by the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.arrowtext import ASCII_LOWER, combine, give_back, mix, shingle_hashes, steps, word_bounds, word_hashes
from lumenfold.operators.graph import connected_components, forest
from lumenfold.session import discard, ship_package, stash

#: Sets of one in-task tree, sets of a tree's leaf, and 64-bit words of a bitmap.
GROUP_SETS, LEAF_SETS, WORDS = 512, 8, 128
#: Bits of the filter that keeps sets without a partner from travelling; false hits only cost time.
FILTER_BITS = 1 << 26
#: Hash families tried for a set whose parts are too often empty, before it goes to its band's common part.
FAMILIES = 8
_SEGMENTS = 1024
#: Pairs that a task holds before it shrinks them, and sets whose parts are keyed in one step.
_HELD_PAIRS, _SIGN_ROWS = 1_000_000, 256
#: Leaves of a group all of whose pairs are traversed; in larger groups sets meet by their parts.
LEAF_PAIRS = 64
#: Rows of the table of candidate sets up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


class Threshold:
    """Links when den * intersection >= num * union, and the bands of set sizes that this allows."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * den // num + 1)
        self.starts = np.array(self.edges, np.int64)

    def needed(self, total):
        """Least intersection of two linked sets with ``total`` elements together."""
        return -(-self.num * total // (self.num + self.den))

    def band(self, k: int) -> tuple[int, int]:
        """Largest symmetric difference of a link whose smaller set is in size class ``k``, and its parts.

        So many parts that even the smallest set of the band mostly has something in more of them than
        may differ; the few others try further families. Small sets keep a few elements a part.
        """
        largest = self.edges[k + 1] - 1
        most = (largest + largest * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        s, parts = self.edges[k], most + 1
        while most and parts < 2 * (most + 1):
            empty = parts * math.exp(-s / parts)
            if parts - empty - 2 * math.sqrt(empty) > most:
                break
            parts += max(1, parts // 64)
        return most, parts


def sets_of(body: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, end to end, and where each begins."""
    starts, ends, first = word_bounds(body, at)
    hashes, begin = shingle_hashes(word_hashes(body, starts, ends, ASCII_LOWER), first, width)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(at)))


def set_digests(hashes: np.ndarray, begin: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; 0 for empty ones."""
    out = []
    for k in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64((2 * seed + k) * 0x9E3779B97F4A7C15 % 2**64)), dtype=np.uint64)])
        out.append(np.where(np.diff(begin) > 0, mix(sums[begin[1:]] - sums[begin[:-1]]), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def part_keys(hashes: np.ndarray, begin: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(set's index, key) of every part of every set, in the band of its size class and in the one before."""
    sizes = np.diff(begin)
    classes = np.searchsorted(t.starts, sizes, "right") - 1
    docs_out, keys_out = [], []

    def emit(values: np.ndarray, doc: np.ndarray, which: np.ndarray, family: int) -> None:
        """``which``: class index of each document's band, by document; -1 for none."""
        bands = {k: t.band(int(k)) for k in np.unique(which[which >= 0])}
        most = np.array([bands[k][0] if k >= 0 else 0 for k in which])
        parts = np.array([bands[k][1] if k >= 0 else 1 for k in which], np.uint64)
        use = most[doc] > 0
        values, doc = values[use], doc[use]
        if not len(doc):
            return
        part = ((values >> np.uint64(32)) * parts[doc]) >> np.uint64(32)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        content = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
        owner = doc[at]
        docs_out.append(owner)
        keys_out.append(combine(content, part[at], which[owner].astype(np.uint64) * np.uint64(64) + np.uint64(family)))
        filled = np.bincount(owner, minlength=len(which))
        few = (most > 0) & (filled <= most)
        if few.any():  # too many parts are empty: another hash family, at last one part for all such sets
            again = np.where(few, which, -1)
            if family + 1 < FAMILIES:
                mine = few[doc]
                other, d = mix(values[mine] + np.uint64(family + 1)), doc[mine]
                order = np.lexsort((other, d))
                emit(other[order], d[order], again, family + 1)
            else:
                lone = np.flatnonzero(few)
                docs_out.append(lone)
                keys_out.append(combine(again[lone].astype(np.uint64), np.full(len(lone), 99, np.uint64)))

    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = np.where(sizes > 0, classes, -1)
    emit(hashes, doc, own, 0)
    emit(hashes, doc, np.where(own > 0, own - 1, -1), 0)
    if not docs_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs_out), np.concatenate(keys_out).view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Token bitmaps of sets: one row of WORDS 64-bit words each."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    for i, s in enumerate(sets):
        bit = (mix(s) & np.uint64(64 * WORDS - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class Components:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


class SignatureTree:
    """Nodes over sets in order of size: OR-combined bitmap, least and largest size, most bits lost to collisions."""

    def __init__(self, sizes: np.ndarray, signatures: np.ndarray):
        self.sizes, self.signatures = sizes, signatures
        self.bits = np.bitwise_count(signatures).sum(1).astype(np.int64)
        self.nodes: list[tuple] = []
        order = np.lexsort((signatures[:, 0], sizes)) if len(sizes) else np.zeros(0, np.int64)
        level = [self.leaf(order[i : i + LEAF_SETS]) for i in range(0, len(order), LEAF_SETS)]
        while len(level) > 1:
            level = [self.parent(level[i : i + 4]) if len(level[i : i + 4]) > 1 else level[i] for i in range(0, len(level), 4)]
        self.root = level[0] if level else None

    def leaf(self, members: np.ndarray) -> int:
        s, lost = self.sizes[members], (self.sizes - self.bits)[members]
        self.nodes.append((members, None, np.bitwise_or.reduce(self.signatures[members]), int(s.min()), int(s.max()), int(lost.max())))
        return len(self.nodes) - 1

    def parent(self, children: list[int]) -> int:
        parts = [self.nodes[c] for c in children]
        self.nodes.append((None, children, np.bitwise_or.reduce([p[2] for p in parts]), min(p[3] for p in parts), max(p[4] for p in parts), max(p[5] for p in parts)))
        return len(self.nodes) - 1


def candidate_pairs(left: SignatureTree, right: SignatureTree, t: Threshold) -> Iterator[tuple[int, int]]:
    """Pairs of sets that sizes and bitmaps allow to link; each unordered pair once if both trees are one."""
    if left.root is None or right.root is None:
        return
    same = left is right
    stack = [(left.root, right.root)]
    while stack:
        a, b = stack.pop()
        members_a, below_a, or_a, low_a, high_a, lost_a = left.nodes[a]
        members_b, below_b, or_b, low_b, high_b, lost_b = right.nodes[b]
        if high_a * t.den < low_b * t.num or high_b * t.den < low_a * t.num:
            continue
        if not (same and a == b):
            shared = int(np.bitwise_count(or_a & or_b).sum()) + min(lost_a, lost_b)
            if shared < t.needed(low_a + low_b):
                continue
        if below_a is None and below_b is None:
            both = np.bitwise_count(left.signatures[members_a][:, None] & right.signatures[members_b][None]).sum(2).astype(np.int64)
            na, nb = left.sizes[members_a][:, None], right.sizes[members_b][None]
            most = np.minimum(na - left.bits[members_a][:, None], nb - right.bits[members_b][None]) + both
            ok = most >= t.needed(na + nb)
            if same and a == b:
                ok &= np.arange(len(members_a))[:, None] < np.arange(len(members_b))[None]
            for i, j in zip(*np.nonzero(ok), strict=True):
                yield int(members_a[i]), int(members_b[j])
        elif same and a == b:
            stack += [(x, y) for i, x in enumerate(below_a) for y in below_a[i:]]
        elif below_b is None or (below_a is not None and high_a >= high_b):
            stack += [(x, b) for x in below_a]
        else:
            stack += [(a, y) for y in below_b]


def linked(x: np.ndarray, y: np.ndarray, t: Threshold) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= t.needed(len(both))


def tree_links(sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Links that join all sets which links connect: pairs inside a component found so far are not tried."""
    out: list[tuple[int, int]] = []
    parts = Components(len(sets))
    if len(sets) == 2:
        return [(0, 1)] if linked(sets[0], sets[1], t) else out
    tree = SignatureTree(np.array(list(map(len, sets)), np.int64), bitmaps(sets))
    for i, j in candidate_pairs(tree, tree, t):
        if parts.find(i) != parts.find(j) and linked(sets[i], sets[j], t):
            parts.join(i, j)
            out.append((i, j))
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of batches that are sorted by their first ``keys`` columns, one list a key."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and rows[0][:keys] != row[:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


_PAIR = ["a", "b"]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=_PAIR)


def _member_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits over the column id, gathered by segments."""
    per = FILTER_BITS // _SEGMENTS
    where = F.pmod(F.col("id"), F.lit(FILTER_BITS))
    cells = ids.select(F.floor(where / per).alias("segment"), F.pmod(where, F.lit(per)).cast("int").alias("bit")).distinct().repartition("segment").sortWithinPartitions("segment")

    def fill(batches):
        for rows in by_group(batches, 1):
            bits = np.zeros(per, bool)
            bits[[r[1] for r in rows]] = True
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in cells.mapInArrow(fill, "segment long, bits binary").collect():
        out[row["segment"] * per // 8 : (row["segment"] + 1) * per // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _tree(rows: list[tuple], size: int, signature: int) -> SignatureTree:
    return SignatureTree(np.array([r[size] for r in rows], np.int64), np.array([np.frombuffer(r[signature], np.uint64) for r in rows], np.uint64).reshape(-1, WORDS))


def _once(rows: list[tuple], at: int) -> list[tuple]:
    """Rows in order of their id at ``at``, one of each."""
    return [r for i, r in enumerate(rows) if not i or rows[i - 1][at] != r[at]]


def _group_links(sets: DataFrame, keys: list[str], t: Threshold) -> DataFrame:
    """Links (a, b) inside each group of ``sets`` (keys, id, n, signature, tokens), which one task can hold.

    Bitmaps meet first: a set that no other of its group may link with by sizes and bits is done, so tokens
    travel for the few others alone.
    """
    width = len(keys)
    deal = lambda rows: rows.repartition(*keys).sortWithinPartitions(*keys, "id")

    def mark(batches):
        for rows in by_group(batches, width):
            rows = _once(rows, width)
            if len(rows) > 1:
                tree, hit = _tree(rows, width + 1, width + 2), np.zeros(len(rows), bool)
                for i, j in candidate_pairs(tree, tree, t):
                    hit[i] = hit[j] = True
                if hit.any():
                    own = [r for r, h in zip(rows, hit, strict=True) if h]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], pa.int64()) for k in range(width + 1)], names=[*keys, "id"])

    def work(batches):
        for rows in by_group(batches, width):
            rows = _once(rows, width)
            if len(rows) > 1:
                found = tree_links([np.frombuffer(r[width + 1], np.uint64) for r in rows], t)
                if found:
                    yield _pairs([(rows[i][width], rows[j][width]) for i, j in found])

    signed = deal(sets.select(*[F.col(k).cast("long").alias(k) for k in keys], "id", "n", "signature"))
    marked = stash(signed.mapInArrow(mark, ", ".join(f"{k} long" for k in [*keys, "id"])), "marked")
    chosen = sets.select("id", "tokens").join(_few(marked), "id").select(*keys, "id", "tokens")
    return deal(chosen).mapInArrow(work, "a long, b long")


def _spanning(pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): edges from each value to the least one that the pairs of a task connect it with."""

    def shrink(batches):
        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
            if len(held) > _HELD_PAIRS:
                yield cut(held)
                held = held[:0]
        yield cut(held)

    def cut(held):
        ids, least = forest(np.unique(held, axis=0))
        return pa.RecordBatch.from_arrays([pa.array(ids[ids != least], pa.int64()), pa.array(least[ids != least], pa.int64())], names=_PAIR)

    return pairs.mapInArrow(shrink, "a long, b long")


def _size_leaves(sets: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """``sets`` (g, id, n, ...) with leaf, by size, and the pairs (g, i, j) of leaves of a group whose sizes allow a link.

    Leaves are about equally large: equal sizes are parted by a hash.
    """
    place = (F.col("n") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("v")
    cuts = sets.select("g", place).groupBy("g").agg(F.percentile_approx("v", [k / LEAF_PAIRS for k in range(1, LEAF_PAIRS)], 10_000).alias("cuts"))
    # A row a group.
    leaved = sets.join(cuts, "g").withColumn("__v", place).withColumn("leaf", F.size(F.filter("cuts", lambda c: c <= F.col("__v"))).cast("long")).drop("cuts", "__v")
    leaved = stash(leaved, "leaves")
    ranges = leaved.groupBy("g", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ranges.select("g", F.col("leaf").alias("j"), F.col("low").alias("jl"), F.col("high").alias("jh"))
    near = (F.col("high") * t.den >= F.col("jl") * t.num) & (F.col("jh") * t.den >= F.col("low") * t.num)
    return leaved, ranges.withColumnRenamed("leaf", "i").join(other, "g").filter((F.col("i") <= F.col("j")) & near).select("g", "i", "j")


def _cross_links(sets: DataFrame, t: Threshold, group_sets: int) -> DataFrame:
    """Links between sets (g, leaves, id, component, n, signature, tokens) of different components of a group.

    The group's sets are dealt to leaves by size, and leaves of like sizes are traversed in pairs on bitmaps
    alone; the pairs of sets that remain are then decided by the sets. In groups of more than LEAF_PAIRS
    times ``group_sets`` sets they meet by the keys of their parts
    instead, but for keys that have sets of one component only; a key with more than ``group_sets``
    sets has several leaves. Called for what large groups still have apart after all else.
    """

    def key(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _SIGN_ROWS):
                part = batch.slice(k, _SIGN_ROWS)
                tokens = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                sizes = np.array(list(map(len, tokens)), np.int64)
                owner, keys = part_keys(np.concatenate(tokens), np.concatenate([[0], np.cumsum(sizes)]), t)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(at), part.column(1).take(at)], names=["key", "id", "component"])

    wide = F.col("leaves") > LEAF_PAIRS
    keyed = stash(sets.filter(wide).select("id", "component", "tokens").mapInArrow(key, "key long, id long, component long"), "keys")
    mixed = keyed.groupBy("key").agg(F.count("*").alias("__n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    leaves = mixed.select("key", F.ceil(F.col("__n") / group_sets).cast("long").alias("leaves"))
    # Only now do signatures travel: with the keys at which sets of different components meet.
    signed = stash(sets.select("id", "n", "signature").dropDuplicates(["id"]), "signatures")
    by_part = keyed.join(leaves, "key").withColumn("leaf", F.pmod(F.xxhash64("id"), F.col("leaves"))).distinct()
    by_part = by_part.join(signed, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("leaves") - 1)))
    by_part = by_part.select("key", F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"), (F.col("leaf") > F.col("other")).alias("second"), "id", "component", "n", "signature")
    narrow = sets.filter(~wide).select("g", "id", "component", "n", "signature").dropDuplicates(["g", "id"])
    leaved, near = _size_leaves(narrow, t)
    sides = near.select("g", F.col("i").alias("leaf"), "i", "j", F.lit(False).alias("second")).unionByName(near.filter("i <> j").select("g", F.col("j").alias("leaf"), "i", "j", F.lit(True).alias("second")))
    by_leaf = leaved.join(sides, ["g", "leaf"]).select(F.col("g").alias("key"), "i", "j", "second", "id", "component", "n", "signature")
    dealt = by_part.unionByName(by_leaf).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second", "id")

    def work(batches):
        for rows in by_group(batches, 3):
            halves = [[r for r in rows if r[3] == side] for side in (False, True)]
            trees = [_tree(half, 6, 7) for half in halves]
            if rows[0][1] == rows[0][2]:  # a leaf with itself
                halves[1], trees[1] = halves[0], trees[0]
            found = [(halves[0][i][4], halves[1][j][4]) for i, j in candidate_pairs(*trees, t) if halves[0][i][5] != halves[1][j][5]]
            if found:
                yield _pairs(found)

    candidates = stash(dealt.mapInArrow(work, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    discard(keyed, signed, leaved)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    tokens = stash(sets.join(_few(wanted), "id", "left_semi").select("id", "tokens").dropDuplicates(["id"]), "tokens")
    both = candidates.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def decide(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            yield _pairs([(a[i], b[i]) for i in range(len(a)) if linked(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), t)])

    links = stash(both.mapInArrow(decide, "a long, b long"), "links")
    discard(candidates, tokens)
    return links


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text_col: str = "text", id_col: str = "doc_id", group_sets: int = GROUP_SETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: id_col, columns ``keep``, n_shingles long, component_id (least id that links reach), set_group long.

    Words are runs of other than space and \t to \r, with A-Z in lower case; the set holds the distinct
    ``width``-word shingles, or the whole sequence of a shorter text, however long the text is. Sets link
    when den * intersection >= num * union. Null texts and texts without words have no shingles, no
    links and no ``set_group``; rows of one component agree in it. Equal sets are one node from the
    start, so copies cost no pairs. An id that repeats, or is null, neither links rows nor parts them:
    each row goes by its text, and a component without any id has a null one. Columns of ``docs`` other
    than id_col and text_col are not read, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    t = Threshold(num, den)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"__keep{k}") for k, c in enumerate(keep)])
    kept = [f"__keep{k}" for k in range(len(keep))]
    described = T.StructType([*T._parse_datatype_string("doc long, n_shingles long, id long, check long").fields, *[source.schema[c] for c in kept]])

    for seed in range(8):

        def describe(batches, seed=seed):
            for batch in batches:
                for i, j, body, at in steps(batch.column(1)):
                    hashes, begin = sets_of(body, at, width)
                    one, two = set_digests(hashes, begin, seed)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(begin)), pa.array(one), pa.array(two), *[batch.column(2 + k).slice(i, j - i) for k in range(len(kept))]], names=described.names)
                give_back()

        nodes = stash(source.mapInArrow(describe, described), "nodes")
        # A 64-bit digest names a set; should two sets ever share one, another seed is used.
        kinds = stash(nodes.filter("n_shingles > 0").groupBy("id").agg(F.min("doc").alias("least"), F.count("*").alias("rows"), (F.min("check") != F.max("check")).alias("clash")), "kinds")
        if kinds.filter("clash").isEmpty():
            break
        discard(nodes, kinds)

    def route(batches):
        for batch in batches:
            for _, _, body, at in steps(batch.column(0)):
                hashes, begin = sets_of(body, at, width)
                ids, _ = set_digests(hashes, begin, seed)
                owner, keys = part_keys(hashes, begin, t)
                if not len(keys):
                    continue
                # Copies, and sets that meet in this batch already, are joined here: the least set of those
                # that parts connect stands for them in their parts, and each shares one key with it.
                ids = ids[owner]
                order = np.lexsort((ids, keys))
                keys, ids = keys[order], ids[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                head = np.repeat(ids[new], np.diff(np.append(np.flatnonzero(new), len(keys))))
                members, labels = forest(np.unique(np.stack([head[head != ids], ids[head != ids]], 1), axis=0))
                stands = ids[new]
                if len(members):
                    place = np.minimum(np.searchsorted(members, stands), len(members) - 1)
                    stands = np.where(members[place] == stands, labels[place], stands)
                other = members != labels
                members, labels = members[other], labels[other]
                own = combine(labels.view(np.uint64), members.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[new], own, own])), pa.array(np.concatenate([stands, labels, members]))], names=["key", "id"])
            give_back()

    keys = source.select("text").mapInArrow(route, "key long, id long")
    # Every set of a part meets the least one, in a running window that holds no more than that.
    least = F.first("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    meets = keys.withColumn("b", least).filter("b <> id").select(F.col("id").alias("a"), "b")
    meets = stash(_spanning(meets).distinct(), "meets")
    groups = connected_components(meets)
    discard(meets)
    groups = groups.withColumnRenamed("component", "g")
    counted = groups.join(groups.groupBy("g").agg(F.count("*").alias("__n")), "g")
    leaves = F.greatest(F.lit(1), F.ceil(F.col("__n") / group_sets)).cast("long")
    members = stash(counted.select("id", "g", leaves.alias("leaves")).withColumn("leaf", F.pmod(F.xxhash64("id"), F.col("leaves"))), "members")
    sent = spark.sparkContext.broadcast(_member_filter(members))

    def gather(batches):
        bits = sent.value
        for batch in batches:
            for _, _, body, at in steps(batch.column(0)):
                hashes, begin = sets_of(body, at, width)
                ids, _ = set_digests(hashes, begin, seed)
                place = ids & (FILTER_BITS - 1)
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                hit = hit[np.unique(ids[hit], return_index=True)[1]]
                own = [hashes[begin[d] : begin[d + 1]] for d in hit]
                columns = [pa.array(ids[hit]), pa.array(list(map(len, own)), pa.int64()), pa.array([m.tobytes() for m in bitmaps(own)], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "signature", "tokens"])
            give_back()

    sets = source.select("text").mapInArrow(gather, "id long, n long, signature binary, tokens binary")
    # Copies of a text may send a set once a task: the groups skip them.
    small = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    sets = stash(sets.join(small, "id"), "sets")
    sent.unpersist()
    links = stash(_group_links(sets, ["g", "leaf"], t), "links")
    large = stash(members.filter("leaves > 1"), "large")
    if not large.isEmpty():
        links = _large_groups(large, sets, links, t, group_sets)
    labels = connected_components(links)
    discard(members, large, sets)
    # Only sets that link, or that several rows have, can have a least id that is not the row's own.
    named = kinds.join(labels, "id", "left").filter("rows > 1 or component is not null").select("id", "least", F.coalesce("component", "id").alias("set_group"))
    least = named.groupBy("set_group").agg(F.min("least").alias("component_id"))
    named = stash(named.join(least, "set_group").select("id", "set_group", "component_id"), "named")
    discard(kinds, labels)
    rest = [F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)]
    full = nodes.filter("n_shingles > 0").join(named, "id", "left").select(F.col("doc").alias(id_col), *rest, "n_shingles", F.when(F.col("set_group").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("set_group", "id").alias("set_group"))
    return full.unionByName(nodes.filter("n_shingles = 0").select(F.col("doc").alias(id_col), *rest, "n_shingles", F.col("doc").alias("component_id"), F.lit(None).cast("long").alias("set_group")))


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _large_groups(large: DataFrame, sets: DataFrame, links: DataFrame, t: Threshold, group_sets: int) -> DataFrame:
    """``links`` with those between the leaves of groups that are too large for one task.

    ``large``: id, g, leaf and leaves of their sets; ``sets``: id, n, signature and tokens. First one set of each
    component meets the others of its group, again and again in groups that a task can hold, while that
    joins anything. Groups that are one component then are done; in the others leaves meet.
    """
    tokens = sets.select("id", "n", "signature", "tokens")
    while True:
        labels = connected_components(links)
        known = stash(large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
        discard(labels)
        kinds = known.select("g", "component").distinct()
        counts = stash(kinds.groupBy("g").agg(F.count("*").alias("__k")).filter("__k > 1"), "counts")
        heads = stash(known.filter("id = component").join(counts, "g").select("id", "g", F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("__k") / group_sets)).alias("part")), "heads")
        more = stash(_group_links(tokens.join(_few(heads), "id"), ["g", "part"], t), "links")
        discard(heads)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        discard(known, counts)
    rest = stash(known.join(counts.select("g"), "g", "left_semi"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_cross_links(tokens.join(_few(rest), "id"), t, group_sets))
    discard(known, counts)
    return links
