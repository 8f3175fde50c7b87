"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of its own, with up to ``ORDER`` bytes. A byte is coded in
the longest context that the tree holds; where that context has not seen it, an escape (method C: as
likely as its distinct bytes to all its counts and distinct bytes) leads to the next shorter one,
without the bytes already ruled out, and at last to a uniform code. Training ends before scoring, so
the code length of a byte depends on its context alone: a tree is a table of code lengths by context
and byte, beside the steps from a context to a longer one. The language with the least length wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import append_columns, flat, steps
from lumenfold.session import discard, ship_package, stash

ORDER = 3
#: A model is fitted on about so many documents of each language, taken by a hash of doc_id.
TRAIN_DOCS = 2000
#: Strings counted that the driver holds at once, bytes of the trees that a worker holds at once, and
#: contexts whose code lengths are computed in one step.
GRAMS_AT_ONCE, MODEL_BYTES, STEP_CONTEXTS = 1_000_000, 160 << 20, 4096
#: Bytes scored in one step.
BLOCK = 1 << 18
#: A text is strange to its language if its bits a byte pass the upper quartile of texts of its size by so
#: many times the distance from median to quartile, and by so much at least; classes of fewer texts say nothing.
SPREADS, LEAST_SPREAD, LEAST_TEXTS = 6.0, 1.5, 20
_START = 256  # stands before the start of a text


class LanguageTree:
    """The contexts of one language: ``steps[k]`` leads from a context and the byte before it to a longer one."""

    def __init__(self, symbol_of: np.ndarray, steps: list[np.ndarray], cost: np.ndarray):
        self.symbol_of, self.steps, self.cost = symbol_of, steps, cost
        self.width = cost.shape[1]
        self.size = cost.nbytes + sum(s.nbytes for s in steps)

    def bits(self, padded: np.ndarray) -> np.ndarray:
        """Code lengths of all bytes of ``padded`` but the first ORDER; 0 for the marks of a start."""
        symbol = self.symbol_of[padded]
        n = len(padded) - ORDER
        state = np.zeros(n, np.int32)
        for k, step in enumerate(self.steps):
            state = step[state * self.width + symbol[ORDER - 1 - k : ORDER - 1 - k + n]]
        return self.cost.reshape(-1)[state * self.width + symbol[ORDER:]]


class PpmModel:
    """Trees of several languages."""

    def __init__(self, languages: list[str], trees: list[LanguageTree]):
        self.languages, self.trees = languages, trees

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        total = np.zeros((len(texts), len(self.trees)))
        for i, j, body, at in steps(texts, 4 * BLOCK):
            padded = np.full(len(body) + ORDER * (j - i), _START, np.int16)
            padded[np.arange(len(body)) + ORDER * np.repeat(np.arange(1, j - i + 1), np.diff(at))] = body
            first = at + ORDER * np.arange(j - i + 1)
            for p in range(ORDER, len(padded), BLOCK):
                q = min(len(padded), p + BLOCK)
                a, b = int(np.searchsorted(first, p, "right")) - 1, int(np.searchsorted(first, q, "left"))
                begin = np.maximum(first[a:b], p) - p
                for k, tree in enumerate(self.trees):
                    total[i + a : i + b, k] += np.add.reduceat(tree.bits(padded[p - ORDER : q]), begin, dtype=np.float64)
        return total

    def parts(self, most: int) -> list[PpmModel]:
        """Models of at most ``most`` bytes, but for single trees that are larger, with all languages between them."""
        out: list[PpmModel] = []
        size = most + 1
        for name, tree in zip(self.languages, self.trees, strict=True):
            if size + tree.size > most:
                out.append(PpmModel([], []))
                size = 0
            out[-1].languages.append(name)
            out[-1].trees.append(tree)
            size += tree.size
        return out


def build_tree(grams: np.ndarray, counts: np.ndarray) -> LanguageTree:
    """A tree from one language's counts of (ORDER + 1)-byte strings, packed with base 257 and the last byte lowest.

    A context is in the tree if it was met twice at least. All arithmetic is on arrays over contexts.
    """
    seen = np.bincount(grams % 257, counts, 257)[:256]
    usual = np.flatnonzero(seen)
    symbols = len(usual) + 1  # 0: any other byte; the last one: a start
    symbol_of = np.zeros(257, np.int32)
    symbol_of[usual] = np.arange(1, symbols)
    symbol_of[_START] = symbols
    wide = symbols + 1
    code = np.zeros(len(grams), np.int64)
    for k in range(ORDER, -1, -1):
        code = code * wide + symbol_of[grams // 257**k % 257]
    code, inverse = np.unique(code, return_inverse=True)
    tally = np.bincount(inverse, counts, len(code))
    kept = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        context, inverse = np.unique(code // wide % wide**k, return_inverse=True)
        known = np.isin(context % wide ** (k - 1), kept[-1]) & (np.bincount(inverse, tally, len(context)) >= 2)
        kept.append(context[known])
    first = np.cumsum([0] + [len(c) for c in kept])
    moves = []
    for k in range(ORDER):
        # Contexts that are shorter than k stay as they are; those of k bytes may get one before them.
        step = np.repeat(np.arange(first[k + 1], dtype=np.int32), wide)
        longer = kept[k + 1]
        parent = first[k] + np.searchsorted(kept[k], longer % wide**k)
        step[parent * wide + longer // wide**k] = first[k + 1] + np.arange(len(longer))
        moves.append(step)
    cost = np.zeros((int(first[-1]), wide), np.float32)
    others = max(1, 256 - len(usual))
    above = rest = prob = None
    for k, contexts in enumerate(kept):
        context, symbol = code // wide % wide**k, code % wide
        order = np.argsort(context, kind="stable")
        context, symbol, n = context[order], symbol[order], tally[order]
        keep: list[list[np.ndarray]] = [[], [], []]
        for a in range(0, len(contexts), STEP_CONTEXTS):
            part = contexts[a : a + STEP_CONTEXTS]
            own = slice(np.searchsorted(context, part[0]), np.searchsorted(context, part[-1], "right"))
            row = np.minimum(np.searchsorted(part, context[own]), len(part) - 1)
            ok = part[row] == context[own]
            table = np.zeros((len(part), symbols))
            np.add.at(table, (row[ok], symbol[own][ok]), n[own][ok])
            in_it = table > 0
            if k == 0:
                lower = np.repeat(1.0 / np.maximum(1, symbols - in_it.sum(1, keepdims=True)), symbols, 1)
            else:
                parent = np.searchsorted(kept[k - 1], part % wide ** (k - 1))
                upper = above[parent]
                free = (upper > 0) & ~in_it
                weight, kinds = (upper * free).sum(1, keepdims=True), free.sum(1, keepdims=True)
                escape = np.where(kinds > 0, kinds / np.maximum(1, weight + kinds), 1.0)
                lower = np.where(upper > 0, upper / np.maximum(1, weight + kinds), escape * rest[parent])
            total, kinds = table.sum(1, keepdims=True), in_it.sum(1, keepdims=True)
            coded = np.where(in_it, table, kinds * lower) / np.maximum(1, total + kinds)
            coded = np.where(total > 0, coded, lower if k == 0 else prob[parent])
            bits = -np.log2(np.maximum(coded, 1e-12))
            bits[:, 0] += np.log2(others)
            cost[first[k] + a : first[k] + a + len(part), :symbols] = bits
            if k < ORDER:
                for held, made in zip(keep, (table, np.where(total > 0, lower, rest[parent]) if k else lower, coded), strict=True):
                    held.append(made)
        if k < ORDER:
            above, rest, prob = (np.concatenate(x) if x else np.zeros((0, symbols)) for x in keep)
    return LanguageTree(symbol_of, moves, cost)


def build_model(languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray]) -> PpmModel:
    """A model from each language's counts of strings; see :func:`build_tree`."""
    return PpmModel(list(languages), [build_tree(g, n) for g, n in zip(grams, counts, strict=True)])


def sample_of(docs: DataFrame, salt: str, most: int | None, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """(lang, text) of about ``most`` documents of each language, by a hash of ``id_col``, or of all; rows without either are out."""
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    if most is None:
        return docs.select("lang", "text")
    sizes = docs.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n"))
    chance = F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, F.col("lang") == F.col("__lang")).filter(chance * F.col("__n") < most).select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int | None = TRAIN_DOCS) -> PpmModel | None:
    """A model of all languages in ``docs``; None if no row has both a text and a language.

    Counts come from about ``most`` documents of each language, taken by a hash of ``id_col``, whole; without ``most``, from all.
    The driver builds one tree after another, from the counts of a few languages at a time.
    """
    ship_package(docs.sparkSession)
    sample = sample_of(docs, "language sample", most, lang_col, id_col, text_col)

    def grams(batches):
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            body, at = flat(batch.column(1))
            for name in sorted(set(names)):
                mine = np.flatnonzero(names == name)
                padded = np.concatenate([np.concatenate([np.full(ORDER, _START, np.int64), body[at[i] : at[i + 1]]]) for i in mine])
                code = np.zeros(len(padded) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    code = code * 257 + padded[k : len(padded) - ORDER + k]
                found, n = np.unique(code[code % 257 != _START], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = stash(sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names: list[str] = []
    trees: list[LanguageTree] = []
    group: list[str] = []
    held = 0
    sizes = sorted((r["lang"], r["count"]) for r in counted.groupBy("lang").count().collect())
    for k, (name, size) in enumerate(sizes):
        group.append(name)
        held += size
        if k + 1 == len(sizes) or held + sizes[k + 1][1] > GRAMS_AT_ONCE:
            rows = counted.filter(F.col("lang").isin(group)).toArrow()
            for x in group:
                own = rows.filter(pc.equal(rows.column(0), x))
                names.append(x)
                trees.append(build_tree(own.column(1).to_numpy(), own.column(2).to_numpy().astype(np.float64)))
            group, held = [], 0
    discard(counted)
    return PpmModel(names, trees) if names else None


def _verdict(languages: list[str], bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each row of code lengths the best language, its length, and the sum of 2^(least - length) over all."""
    best = bits.argmin(1)
    least = bits[np.arange(len(bits)), best]
    return [languages[i] for i in best], least, np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)


def identify(docs: DataFrame, model: PpmModel | None, text_col: str = "text", keep: list[str] | None = None, most: int = MODEL_BYTES) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred string, score double (0 to 1) and bits_per_byte double.

    ``score`` is the posterior of the language under equal priors. ``und`` with score 0 stands for a
    null text, a text without a letter, or a missing model. Ties go to the first language by name.
    Texts count whole, however long; repeated rows stay, and columns of ``docs`` named like a new one
    give way. A model of more than ``most`` bytes is sent part by part, and texts are read once for each.
    """
    kept = docs.columns if keep is None else keep
    parts = model.parts(most) if model is not None else []
    flagged = docs.withColumn("__letters", F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    if len(parts) > 1:
        return _finished(_by_parts(flagged, parts, text_col, kept), kept)
    sent = docs.sparkSession.sparkContext.broadcast(parts[0] if parts else None)

    def make():
        ppm = sent.value

        def work(texts: pa.Array) -> list:
            if ppm is None:
                return [pa.array([None] * len(texts), pa.string()), np.zeros(len(texts)), np.zeros(len(texts))]
            names, least, weight = _verdict(ppm.languages, ppm.code_lengths(texts))
            return [pa.array(names, pa.string()), 1 / weight, least / np.maximum(1, np.diff(flat(texts)[1]))]

        return work

    return _finished(append_columns(flagged, make, "lang_pred string, score double, bits_per_byte double", text_col, [*kept, "__letters"]), kept)


def _finished(found: DataFrame, kept: list[str]) -> DataFrame:
    real = F.col("__letters") & F.col("lang_pred").isNotNull()
    names = [c for c in kept if c not in ("lang_pred", "score", "bits_per_byte")]
    return found.select(*[F.col(f"`{c}`") for c in names], F.when(real, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(real, F.col("score")).otherwise(0.0).alias("score"), "bits_per_byte")


def _by_parts(flagged: DataFrame, parts: list[PpmModel], text_col: str, kept: list[str]) -> DataFrame:
    """:func:`identify` with one pass for each part of a model: the parts' verdicts meet by row."""
    names = [c for c in kept if c not in ("lang_pred", "score", "bits_per_byte")]
    rows = stash(flagged.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col, "__letters"])]).withColumn("__n", F.monotonically_increasing_id()), "rows")
    found = []
    for part in parts:
        sent = flagged.sparkSession.sparkContext.broadcast(part)

        def make(sent=sent):
            ppm = sent.value

            def work(texts: pa.Array) -> list:
                names, least, weight = _verdict(ppm.languages, ppm.code_lengths(texts))
                return [pa.array(names, pa.string()), least, weight, np.maximum(1, np.diff(flat(texts)[1]))]

            return work

        found.append(stash(append_columns(rows, make, "lang_pred string, __bits double, __weight double, __bytes long", text_col, ["__n"]), "verdicts"))
        sent.unpersist()
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    least = together.groupBy("__n").agg(F.min(F.struct("__bits", "lang_pred")).alias("best"), F.max("__bytes").alias("__bytes"), F.collect_list(F.struct("__bits", "__weight")).alias("all"))
    weight = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["__weight"] * F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.col("best")["__bits"] - x["__bits"])))
    scored = least.select("__n", F.col("best")["lang_pred"].alias("lang_pred"), (1 / weight).alias("score"), (F.col("best")["__bits"] / F.col("__bytes")).alias("bits_per_byte"))
    return rows.join(scored, "__n").drop("__n")


def size_class(text_col: str = "text"):
    """Texts of one class differ in their bytes by less than a factor of four."""
    return F.floor(F.log2(F.greatest(F.octet_length(text_col), F.lit(1))) / 2).cast("int")


def spreads(docs: DataFrame, model: PpmModel | None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = TRAIN_DOCS) -> DataFrame:
    """(lang_pred, size_class, most_bits): bits a byte that texts of a language and size hardly pass.

    From about ``most`` documents of each language, by another hash than that of training.
    """
    return spreads_of(identify(sample_of(docs, "language spread", most, lang_col, id_col, text_col), model))


def spreads_of(named: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """:func:`spreads` from all rows of what :func:`identify` gave."""
    scored = named.filter(F.col("lang_pred") == F.col(lang_col)).withColumn("size_class", size_class(text_col))
    by = scored.groupBy("lang_pred", "size_class").agg(F.percentile_approx("bits_per_byte", [0.5, 0.75], 1000).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    return by.select("lang_pred", "size_class", (F.col("q")[1] + F.greatest(F.lit(LEAST_SPREAD), SPREADS * (F.col("q")[1] - F.col("q")[0]))).alias("most_bits"))
