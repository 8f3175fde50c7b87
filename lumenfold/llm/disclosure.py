"""Personal data: pattern spans, secrets, and terms that disclose protected entities.

Base spans are addresses, card and phone numbers by pattern. Secrets are long runs in which letters and
digits take turns, as in keys and tokens: so much information that no word of a language has it.
Protected entities are each value found, what it generalises to (the domain and the names of an address,
the first parts of a number or a secret), and that there is personal data of its kind at all. Over the
corpus, a term's pointwise mutual information with an entity, from counts of whole documents with
either and both, says how much of the entity's information content the term gives away; all
places of terms that give away more than a threshold are spans too, to be generalised or removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import ASCII_LOWER, _powers, append_columns, mix, steps, word_hashes
from lumenfold.session import ship_package, stash

KINDS = ("email", "ip", "card", "phone")
#: Code points of a term at least.
LEAST_LETTERS = 3
#: Share of an entity's information content that a term may not give away, the differing
#: texts that must show the two together, and those without the entity that an estimate from few texts reckons with.
DISCLOSED, LEAST_CONTEXTS, UNSEEN = 0.9, 3, 2
#: Bits of the filter that keeps words which are no candidate from being counted.
FILTER_BITS = 1 << 24
#: Rows of keys up to which they are broadcast; more are joined by shuffle, each dealt over SALTS tasks.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Counts of terms that a task holds before it hands them on.
COUNTED_TERMS = 500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails from the first digit of a run fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
# A secret: so many characters, and changes between letters and digits, at least.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_TURN = re.compile("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
LEAST_TURNS = 5
# A term is a run of letters, or of anything outside ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(secret, start, end) of the secrets that share no character with a base span."""
    out = []
    for m in _SECRET.finditer(text):
        a, b = m.span()
        if len(_TURN.findall(m[0])) >= LEAST_TURNS and not any(x < b and a < y for _, x, y in base):
            out.append(("secret", a, b))
    return out


def entities_of(kind: str, value: str) -> list[str]:
    """What a value protects: itself, what it generalises to, and its kind."""
    digits = "".join(_DIGITS.findall(value))
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        parts = [value.lower(), f"@{domain}", *[f"{name}@" for name in re.findall(f"[a-z]{{{LEAST_LETTERS},}}", local)]]
    elif kind == "ip":
        parts = [value, ".".join(value.split(".")[:2])]
    elif kind == "secret":
        parts = [value, value[:4]]
    else:
        parts = [digits, digits[: 6 if kind == "card" else 4]]
    return [f"{kind}:{p}" for p in dict.fromkeys(parts)] + [f"{kind}:"]


def term_bounds(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in ``body``, of any length, and the index of each one's document."""
    inside = _LETTER[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]) | inside & first[:-1])
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]]) | inside & first[1:]) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def code_points(body: np.ndarray) -> np.ndarray:
    """Of every byte offset up to the end: the code points that begin before it."""
    return np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])


def terms_of(text: str) -> tuple[np.ndarray, int]:
    """The distinct hashes of all terms of a text, and a hash of their sequence, which copies share."""
    body = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = term_bounds(body, np.array([0, len(body)]))
    points = code_points(body)
    long = points[ends] - points[starts] >= LEAST_LETTERS
    hashes = word_hashes(body, starts[long], ends[long], ASCII_LOWER)
    sequence = mix(np.sum(hashes * _powers(len(hashes)), keepdims=True) + np.uint64(len(hashes)))
    return np.unique(hashes.view(np.int64)), int(sequence.view(np.int64)[0])


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def make():
        def work(texts: pa.Array) -> list:
            spans, secrets, entities, terms, sequences = [], [], [], [], []
            for value in texts:
                text = value.as_py() or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                hidden = secret_spans(text, found)
                secrets.append([{"kind": k, "start": a, "end": b} for k, a, b in hidden])
                found = found + hidden
                entities.append(sorted({e for k, a, b in found for e in entities_of(k, text[a:b])}))
                hashes, sequence = terms_of(text) if found else ((), 0)
                terms.append(hashes)
                sequences.append(sequence)
            return [pa.array(spans, _SPAN_TYPE), pa.array(secrets, _SPAN_TYPE), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.int64())), pa.array(sequences, pa.int64())]

        return work

    return append_columns(docs, make, f"base {_SPAN}, secrets {_SPAN}, __entities array<string>, __terms array<long>, __sequence long", text_col, keep)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A fixed-size bitmap with the places of ``hashes`` (hash)."""
    cells = hashes.select(F.pmod("hash", F.lit(FILTER_BITS)).cast("int").alias("cell")).distinct()
    wanted = np.zeros(FILTER_BITS, bool)
    # At most FILTER_BITS numbers, whatever the size of the corpus.
    wanted[cells.toArrow().column(0).to_numpy()] = True
    return np.packbits(wanted, bitorder="little")


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & (FILTER_BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``, which has each once; a frequent key is dealt over SALTS tasks."""
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    salted = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], "left_semi").drop("__salt")


def term_documents(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, n): texts of ``docs`` that hold each of ``terms`` (hash), counted over all of them.

    A fixed-size bitmap of the wanted hashes keeps other words from the shuffle; the join after it
    removes its false hits.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def count(batches):
        bits = sent.value
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, body, at in steps(batch.column(0)):
                starts, ends, doc = term_bounds(body, at)
                hashes = word_hashes(body, starts, ends, ASCII_LOWER).view(np.int64)
                hit = _marked(bits, hashes)
                pairs = np.unique(np.stack([hashes[hit], doc[hit]], 1), axis=0)
                more, times = np.unique(pairs[:, 0], return_counts=True)
                found, place = np.unique(np.concatenate([found, more]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n, times]), len(found)).astype(np.int64)
                if len(found) > COUNTED_TERMS:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["hash", "n"])
                    found, n = found[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["hash", "n"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n")).join(terms.select("hash").distinct(), "hash")


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(__row, terms): every place of ``terms`` (hash) in the texts of ``docs`` (__row and text_col) outside base spans and secrets."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def search(batches):
        bits = sent.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for i, _, body, at in steps(batch.column(1)):
                starts, ends, doc = term_bounds(body, at)
                hashes = word_hashes(body, starts, ends, ASCII_LOWER).view(np.int64)
                hit = _marked(bits, hashes)
                starts, ends, doc, hashes = starts[hit], ends[hit], doc[hit], hashes[hit]
                out = []
                for d in np.unique(doc):
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    text = body[at[d] : at[d + 1]]
                    points = code_points(text)
                    a, b = points[starts[own] - at[d]], points[ends[own] - at[d]]
                    free = np.ones(len(a), bool)
                    whole = text.tobytes().decode()
                    base = base_spans(whole)
                    base = sorted((x, y) for _, x, y in base + secret_spans(whole, base))
                    if base:
                        reach = np.concatenate([[0], np.maximum.accumulate([y for _, y in base])])
                        free = reach[np.searchsorted([x for x, _ in base], b)] <= a
                    out.append((np.full(int(free.sum()), rows[i + d]), hashes[own][free], a[free], b[free]))
                if out:
                    row, found, a, b = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(found, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["__row", "hash", "start", "end"])

    hits = docs.select("__row", F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(search, "__row long, hash long, start int, end int")
    spans = _having(hits, terms, "hash").select("__row", F.struct(F.lit("term").alias("kind"), "start", "end").alias("s"))
    return spans.groupBy("__row").agg(F.sort_array(F.collect_set("s")).alias("terms"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text", disclosed: float = DISCLOSED, least: int = LEAST_CONTEXTS) -> DataFrame | None:
    """(hash) of terms that give away at least ``disclosed`` of an entity's information; None if none can.

    ``found``: rows (__at, __entities, __terms, __sequence), one a text. Entity and term are together in a
    text wherever they stand in it. Copies of a text, with one sequence of terms, show one surrounding
    only. Kinds of personal data are in many texts, which few rare words can share by chance: how likely a term has
    the kind beside it is estimated as if ``UNSEEN`` more differing texts had shown it alone. An entity of all texts has no
    information to give away.
    """
    held = found.select("__at", "__sequence", F.explode("__entities").alias("entity")).withColumns({"broad": F.col("entity").endswith(":"), "entity": F.xxhash64("entity")})
    # Texts with one sequence have the same terms, so one of them stands for all.
    kinds = stash(held.groupBy("entity", "broad", "__sequence").agg(F.count("*").alias("n"), F.min("__at").alias("__at")), "kinds")
    entities = stash(kinds.groupBy("entity", "broad").agg(F.sum("n").alias("of_entity"), F.count("*").alias("kinds")).filter(F.col("kinds") >= least).drop("kinds"), "entities")
    if entities.isEmpty():
        return None
    shown = _having(kinds, entities.select("entity"), "entity").select("__at", "entity", "n")
    texts = found.filter(F.size("__entities") > 0).select("__at", "__terms")
    pairs = shown.join(texts, "__at").select("entity", "n", F.explode("__terms").alias("hash"))
    pairs = pairs.groupBy("entity", "hash").agg(F.count("*").alias("kinds"), F.sum("n").alias("both")).filter(F.col("kinds") >= least)
    n = docs.count()
    seen = F.when(F.col("broad"), F.col("kinds") / (F.col("kinds") + UNSEEN)).otherwise(1.0)
    mutual = F.log2(seen * F.col("both") * F.lit(float(n)) / (F.col("of_entity") * F.col("of_term")))
    told = mutual >= disclosed * F.log2(F.lit(float(n)) / F.col("of_entity"))
    known = entities.filter(F.col("of_entity") < n)
    known = F.broadcast(known) if entities.count() <= BROADCAST_ROWS else known
    pairs = pairs.join(known, "entity").select("entity", "broad", "hash", "kinds", "both", "of_entity")
    # A term is in as many texts at least as in those with any entity: what is too frequent there need not be counted.
    least_of = texts.select(F.explode("__terms").alias("hash")).groupBy("hash").agg(F.count("*").alias("of_term"))
    pairs = stash(pairs.join(least_of, "hash").filter(told).drop("of_term"), "pairs")
    if pairs.isEmpty():
        return None
    terms = term_documents(docs, pairs, text_col).withColumnRenamed("n", "of_term")
    told = stash(pairs.join(terms, "hash").filter(told).select("hash").distinct(), "disclosing")
    return None if told.isEmpty() else told


def find_personal(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", disclosed: float = DISCLOSED, least: int = LEAST_CONTEXTS) -> DataFrame:
    """One row a row of ``docs``: id_col, base, secrets and terms, arrays of (kind, start, end) in code points.

    Base spans are in the order of KINDS, then start; terms (kind ``term``) by start, in every text that
    holds one, also without the entity. Null texts are empty, and texts count whole, however long. Rows that repeat
    an id keep their own spans, rows that repeat id and text are alike, columns of ``docs`` other than the two
    are not read, whatever their names, and an empty table gives none.
    """
    docs = docs.select(id_col, text_col)
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col)))
    found = stash(_find(keyed, text_col, [id_col, "__row"]).withColumn("__at", F.monotonically_increasing_id()), "spans")
    told = disclosing_terms(found, docs, text_col, disclosed, least)
    base = found.select(id_col, "__row", "base", "secrets")
    if told is None:
        return base.select(id_col, "base", "secrets", F.expr(f"cast(array() as {_SPAN})").alias("terms"))
    spans = term_spans(keyed, told, text_col)
    return base.join(spans, "__row", "left").select(id_col, "base", "secrets", F.coalesce("terms", F.expr(f"cast(array() as {_SPAN})")).alias("terms"))


def span_text(spans) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with base spans and secrets generalised to [KIND] and disclosing terms removed to [TERM].

    Of overlapping spans the one that begins first, and then the longer, is replaced; ids must be unique.
    """
    spans = found.select(F.col(id_col).alias("__id"), F.array_sort(F.concat("base", "secrets", "terms"), lambda a, b: (F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))).alias("__spans"))
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(piece.alias("out"), s["end"].alias("at")))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.join(spans, F.col(id_col) == F.col("__id"), "left").withColumn(text_col, F.when(text.isNull() | F.col("__spans").isNull(), text).otherwise(clean)).drop("__id", "__spans")
