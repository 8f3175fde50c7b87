"""Line dedup by a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its first two tokens, where
a token with a digit is a variable field. A leaf's lines are merged by the tokens that they share by
place: a token's support is the number of differing lines of the leaf that have it there, a line's
support that which two thirds of its tokens reach, and tokens with less than half of it are variable
fields of the line's template. Lines that differ in fields alone so come to one template. A template,
or a line as it is, that recurs in enough documents is dropped from all of them but the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import _powers, combine, give_back, mix, steps, word_bounds, word_hashes
from lumenfold.session import discard, ship_package, stash

#: A template that keeps w tokens recurs in EVIDENCE / w documents, two at least.
EVIDENCE = 24
#: Tokens that a template with variable fields keeps at least: two thirds of its line's, and so many.
GENERAL_KEPT = 4
#: Tokens of all lines of a leaf, and of one line, up to which one task merges the leaf; beyond, joins do.
LEAF_TOKENS, LINE_TOKENS = 1 << 20, 2048
#: Tokens merged in one step, and tasks that a frequent token of a large leaf is dealt over.
STEP_TOKENS, SALTS = 1 << 18, 16
#: Bits of the filter of leaves whose lines travel; false hits are joined away.
FILTER_BITS = 1 << 24
#: Recurring lines up to which they are broadcast, 16 bytes each; more meet the documents by shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows whose texts are rebuilt in one step.
OUT_ROWS = 1024
_FIELD = np.uint64(0x1F83D9ABFB41BD6B)


def parse(body: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of every line with a token: its document's index, its number in it, its tokens, leaf and key; and all tokens' hashes."""
    starts, ends, first = word_bounds(body, at)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("doc", "line", "tokens", "leaf", "key", "begin")} | {"words": np.zeros(0, np.uint64)}
    digit = np.concatenate([[0], np.cumsum((body >= 48) & (body <= 57))])
    words = np.where(digit[ends] > digit[starts], _FIELD, word_hashes(body, starts, ends))
    breaks = np.concatenate([[0], np.cumsum(body == 10)])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    line = breaks[starts] - breaks[at[doc]]
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(new)
    tokens = np.diff(np.append(begin, len(starts)))
    place = np.arange(len(starts)) - np.repeat(begin, tokens)
    second = np.where(tokens > 1, words[np.minimum(begin + 1, len(words) - 1)], np.uint64(0))
    leaf = combine(tokens.astype(np.uint64), words[begin], second)
    key = combine(leaf, np.add.reduceat(words * _powers(int(tokens.max()))[place], begin))
    return {"doc": doc[begin], "line": line[begin], "tokens": tokens, "leaf": mix(leaf).view(np.int64), "key": mix(key).view(np.int64), "begin": begin, "words": words}


def needed_documents(kept: Column) -> Column:
    """Documents in which a template recurs, by the tokens that it keeps."""
    return F.greatest(F.lit(2), F.ceil(F.lit(float(EVIDENCE)) / kept))


def merge(leaf: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line's index, template, kept tokens) of the lines of whole leaves that get a template with fields.

    ``words``: the token hashes of all lines, end to end; each line is there once.
    """
    n = len(tokens)
    begin = np.cumsum(tokens) - tokens
    line = np.repeat(np.arange(n), tokens)
    place = np.arange(len(words)) - begin[line]
    at_place = combine(leaf[line].view(np.uint64), place.astype(np.uint64), words.astype(np.uint64))
    _, inverse, counts = np.unique(at_place, return_inverse=True, return_counts=True)
    support = counts[inverse]
    least = -(-2 * tokens // 3)
    reached = support[np.lexsort((-support, line))][begin + least - 1]
    keep = 2 * support >= np.maximum(reached, 4)[line]
    kept = np.add.reduceat(keep, begin) if n else np.zeros(0, np.int64)
    template = np.add.reduceat(np.where(keep, mix(at_place), np.uint64(0)), begin) if n else np.zeros(0, np.uint64)
    some = np.flatnonzero((reached >= 2) & (kept < tokens) & (kept >= np.maximum(GENERAL_KEPT, least)))
    return some, mix(combine(template[some], kept[some].astype(np.uint64))).view(np.int64), kept[some]


def _whole_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (leaf, key), cut between leaves, without rows that repeat a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        leaf = batch.column(0).to_numpy()
        other = np.flatnonzero(leaf != leaf[-1]) if len(leaf) else leaf
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield _distinct(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _distinct(pa.concat_batches(held))


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    key = batch.column(1).to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return batch.filter(pa.array(new))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _whole_leaves(batches):
        leaf, key, tokens = (batch.column(i).to_numpy() for i in range(3))
        words = batch.column(3).flatten().to_numpy().view(np.uint64)
        upto = np.concatenate([[0], np.cumsum(tokens)])
        edges = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf)) if len(leaf) else np.zeros(1, np.int64)
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(upto[edges], upto[edges[i]] + STEP_TOKENS, "right")) - 1)
            a, b = edges[i], edges[j]
            some, template, kept = merge(leaf[a:b], tokens[a:b], words[upto[a] : upto[b]])
            yield pa.RecordBatch.from_arrays([pa.array(key[a:b][some]), pa.array(template), pa.array(kept, pa.int64())], names=["key", "template", "kept"])
            i = j


def _merged_by_joins(shapes: DataFrame) -> DataFrame:
    """What :func:`merge` gives, for leaves that no task can hold."""
    one = shapes.dropDuplicates(["key"]).select("leaf", "key", "tokens", F.posexplode("words").alias("place", "word"))
    one = one.withColumn("salt", F.pmod("key", F.lit(SALTS)))
    support = one.groupBy("leaf", "place", "word").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    items = one.join(support, ["leaf", "place", "word", "salt"]).groupBy("leaf", "key", "tokens").agg(F.sort_array(F.collect_list(F.struct("n", "place", "word")), asc=False).alias("items"))
    least = F.ceil(F.col("tokens") * 2 / 3).cast("int")
    found = items.withColumn("reached", F.element_at("items", least)["n"]).withColumn("kept_items", F.filter("items", lambda x: 2 * x["n"] >= F.greatest(F.col("reached"), F.lit(4))))
    found = found.withColumn("kept", F.size("kept_items").cast("long")).filter((F.col("reached") >= 2) & (F.col("kept") < F.col("tokens")) & (F.col("kept") >= F.greatest(F.lit(GENERAL_KEPT), least)))
    return found.select("key", F.xxhash64("leaf", F.sort_array(F.transform("kept_items", lambda x: F.struct(x["place"], x["word"])))).alias("template"), "kept")


def general_templates(source: DataFrame, kinds: DataFrame, leaf_tokens: int = LEAF_TOKENS) -> DataFrame:
    """(key, template, kept) of the lines of ``source`` (text) whose template has variable fields.

    ``kinds``: leaf, key and tokens of every differing line. Only leaves with several of them matter.
    """
    long_enough = F.col("tokens") > GENERAL_KEPT
    leaves = stash(kinds.filter(long_enough).groupBy("leaf").agg(F.count("*").alias("lines"), F.max("tokens").alias("width")).filter("lines > 1"), "leaves")
    cells = leaves.select(F.pmod("leaf", F.lit(FILTER_BITS)).cast("int").alias("cell")).distinct()
    wanted = np.zeros(FILTER_BITS, bool)
    # At most FILTER_BITS numbers, whatever the size of the corpus.
    wanted[cells.toArrow().column(0).to_numpy()] = True
    sent = source.sparkSession.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))

    def shape(batches):
        bits = sent.value
        for batch in batches:
            for _, _, body, at in steps(batch.column(0)):
                found = parse(body, at)
                place = found["leaf"] & (FILTER_BITS - 1)
                hit = np.flatnonzero(((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0) & (found["tokens"] > GENERAL_KEPT))
                hit = hit[np.unique(found["key"][hit], return_index=True)[1]]
                tokens, begin = found["tokens"][hit], found["begin"][hit]
                offsets = np.concatenate([[0], np.cumsum(tokens)])
                words = found["words"][np.repeat(begin - offsets[:-1], tokens) + np.arange(offsets[-1])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(found["leaf"][hit]), pa.array(found["key"][hit]), pa.array(tokens), lists], names=["leaf", "key", "tokens", "words"])
            give_back()

    shapes = source.select("text").mapInArrow(shape, "leaf long, key long, tokens long, words array<long>").join(leaves, "leaf")
    small = (F.col("lines") * F.col("width") <= leaf_tokens) & (F.col("width") <= LINE_TOKENS)
    shapes = stash(shapes.select("leaf", "key", "tokens", "words", small.alias("small")), "shapes")
    discard(leaves)
    dealt = shapes.filter("small").select("leaf", "key", "tokens", "words").repartition("leaf").sortWithinPartitions("leaf", "key")
    out = stash(dealt.mapInArrow(_merged, "key long, template long, kept long").unionByName(_merged_by_joins(shapes.filter("not small").drop("small"))), "general")
    discard(shapes)
    sent.unpersist()
    return out


def _salted(table: DataFrame) -> DataFrame:
    """``table`` (key, ...) once for each salt, for lines that meet it by key and ``salt``, a rest of their document."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _with_salt(lines: DataFrame) -> DataFrame:
    """A line's documents over as many tasks as there are salts, so that a very common line is in no one task."""
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))


def recurring_templates(lines: DataFrame, kinds: DataFrame, general: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, first) of the templates with fields that recur, with their first document; and a stash to discard after.

    A template recurs if one of its lines alone does in enough documents, and does not if all its lines
    are in too few together. Only between the two do its documents count, and then each of its lines is
    in fewer than six: a template keeps four tokens at least. No common line is looked at.
    """
    of = general.join(kinds.select("key", "n", "first"), "key").groupBy("template", "kept").agg(F.max("n").alias("one"), F.sum("n").alias("all"), F.min("first").alias("first"))
    of = stash(of.withColumn("needed", needed_documents(F.col("kept"))).filter("all >= needed"), "templates")
    open_keys = general.join(of.filter("one < needed").select("template", "needed"), "template").select("key", "template", "needed")
    counted = _with_salt(lines.select("key", "doc")).join(_salted(open_keys), ["key", "salt"]).select("template", "needed", "doc").distinct().groupBy("template", "needed").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    return of.filter("one >= needed").select("template", "first").unionByName(counted.filter("n >= needed").select("template", "first")), of


def recurring_lines(source: DataFrame, leaf_tokens: int = LEAF_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(key, first) of the lines whose template recurs, with its first document; and all lines (doc, row, line, key).

    ``source``: doc (long, not null), row (long) and text (not null).
    """
    ship_package(source.sparkSession)

    def read(batches):
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, body, at in steps(batch.column(2)):
                found = parse(body, at)
                where = found["doc"] + i
                yield pa.RecordBatch.from_arrays([pa.array(doc[where]), pa.array(row[where]), *[pa.array(found[c]) for c in ("line", "tokens", "leaf", "key")]], names=["doc", "row", "line", "tokens", "leaf", "key"])
            give_back()

    lines = stash(source.select("doc", "row", "text").mapInArrow(read, "doc long, row long, line long, tokens long, leaf long, key long"), "lines")
    kinds = stash(lines.select("leaf", "key", "tokens", "doc").distinct().groupBy("leaf", "key", "tokens").agg(F.count("*").alias("n"), F.min("doc").alias("first")), "kinds")
    general = general_templates(source, kinds, leaf_tokens)
    wide, templates = recurring_templates(lines, kinds, general)
    exact = kinds.filter(F.col("n") >= needed_documents(F.col("tokens"))).select("key", "first")
    firsts = stash(exact.unionByName(general.join(wide, "template").select("key", "first")).groupBy("key").agg(F.min("first").alias("first")), "recurring")
    discard(kinds, general, templates)
    return firsts, lines


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", leaf_tokens: int = LEAF_TOKENS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with text_col without recurring lines, and n_lines, n_dropped (long).

    Lines are what newlines part, of any length; a line without a token is never a template. The
    document with the least id keeps a recurring template's lines; a null id comes last. A null text
    stays null with no lines. Rows that repeat id and text are alike; columns of ``docs`` named like a
    new one give way. An empty table gives an empty one. Up to ``broadcast_keys`` recurring lines go to
    the documents, which then stay where they are.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = [F.col(f"`{c}`") for c in columns]
    doc, row = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)), F.xxhash64(f"`{id_col}`", f"`{text_col}`")
    firsts, lines = recurring_lines(docs.select(doc.alias("doc"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), leaf_tokens)
    n, at = len(columns), columns.index(text_col)

    def cut(batch: pa.RecordBatch, drops: list) -> pa.RecordBatch:
        out, counts = [], []
        for text, drop in zip(batch.column(at), drops, strict=True):
            value = text.as_py()
            counts.append(0 if value is None else value.count("\n") + 1)
            if drop is not None and len(drop):
                bad = set(drop)
                value = "\n".join([x for k, x in enumerate(value.split("\n")) if k not in bad])
            out.append(value)
        arrays = [batch.column(i) for i in range(n)]
        arrays[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array([0 if d is None else len(d) for d in drops], pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    def parts(batches):
        for batch in batches:
            yield from (batch.slice(k, OUT_ROWS) for k in range(0, batch.num_rows, OUT_ROWS))
            give_back()

    if firsts.count() <= broadcast_keys:
        table = firsts.toArrow().sort_by("key")
        sent = docs.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), table.column(1).to_numpy()))
        discard(lines)

        def look(batches):
            keys, first = sent.value
            for batch in parts(batches):
                ids, drops = batch.column(n).to_numpy(), [None] * batch.num_rows
                for i, _, body, begin in steps(batch.column(at)) if len(keys) else ():
                    found = parse(body, begin)
                    place = np.minimum(np.searchsorted(keys, found["key"]), len(keys) - 1)
                    where = found["doc"] + i
                    hit = np.flatnonzero((keys[place] == found["key"]) & (ids[where] > first[place]))
                    edges = np.append(np.flatnonzero(np.append(True, where[hit][1:] != where[hit][:-1])), len(hit)) if len(hit) else np.zeros(1, np.int64)
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        drops[where[hit[a]]] = found["line"][hit[a:b]].tolist()
                yield cut(batch, drops)

        joined, work = docs.select(*own, doc.alias("__doc")), look
    else:
        hits = _with_salt(lines.select("doc", "row", "line", "key")).join(_salted(firsts), ["key", "salt"]).filter(F.col("doc") > F.col("first"))
        found = stash(hits.groupBy("doc", "row").agg(F.sort_array(F.collect_set("line")).alias("lines")), "drops").toDF("__found_doc", "__found_row", "__found_lines")
        discard(lines)
        keyed = docs.select(*own, doc.alias("__doc"), row.alias("__row"))
        joined = keyed.join(found, (F.col("__doc") == F.col("__found_doc")) & (F.col("__row") == F.col("__found_row")), "left").select(*own, "__found_lines")

        def work(batches):
            for batch in parts(batches):
                yield cut(batch, batch.column(n).to_pylist())

    discard(firsts)
    schema = docs.select(*own).schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(work, schema)
