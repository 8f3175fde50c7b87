"""Token counts from distinct pre-tokens.

The byte-level BPE vocabulary splits a text into pre-tokens that are merged on their own, so the
number of tokens of a text is the sum, over its distinct pre-tokens, of pieces times frequency. Each
document becomes a list of its pre-tokens with their frequencies; the table of distinct pre-tokens of
the corpus gets a number of pieces, once for each; and a join of the two gives the sums. No document
has a list of ids at any time.
"""

from __future__ import annotations

import functools
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import append_columns
from lumenfold.session import discard, ship_package, stash

#: Pre-tokens, the most frequent ones, that are broadcast, and their bytes; documents meet the others by shuffle.
COMMON_ROWS, COMMON_BYTES = 200_000, 32 << 20
#: Steps in which numbers of documents double, where the frequent pre-tokens are told from the others.
STEPS = 8
#: Texts whose frequencies are turned into an Arrow array in one step.
STEP_TEXTS = 256


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol that a byte-level vocabulary writes for each byte, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PreTokens:
    """Pre-tokens of texts, and their pieces, by one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.path, self.pattern = path, public_tokenizers.PATTERN
        self.specials = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.find = regex.compile(self.pattern).findall

    def frequencies(self, text: str) -> Counter:
        """How often each pre-token is in ``text``; special strings are pre-tokens of their own."""
        if self.special is None or not self.special.search(text):
            return Counter(self.find(text))
        out: Counter = Counter()
        for part in self.special.split(text):
            out.update([part] if part in self.specials else self.find(part))
        return out

    @functools.cached_property
    def encode(self):
        import tiktoken

        to_byte = byte_of_symbol()
        ranks = {bytes(map(to_byte.__getitem__, piece)): i for piece, i in self.file["model"]["vocab"].items() if piece not in self.specials}
        return tiktoken.Encoding(self.path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pieces(self, token: str) -> int:
        """Tokens of one pre-token as the library's encode() without added tokens gives them."""
        return 1 if token in self.specials else len(self.encode(token))


@functools.cache
def pre_tokens(path: str) -> PreTokens:
    """One for all tasks of a Python worker."""
    return PreTokens(path)


_ENTRY = pa.struct([("token", pa.string()), ("times", pa.int32())])


def _lists(found: list[Counter]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in found])])
    entries = pa.StructArray.from_arrays([pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int32())], fields=list(_ENTRY))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def frequencies(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``keep``) with n_bytes long and frequencies, an array of (token, times)."""

    def make():
        tokens = pre_tokens(vocabulary)

        def work(texts: pa.Array) -> list:
            sizes, lists = np.zeros(len(texts), np.int64), []
            for a in range(0, len(texts), STEP_TEXTS):
                found = []
                for i, value in enumerate(texts.slice(a, STEP_TEXTS), a):
                    text = value.as_py() or ""
                    sizes[i] = len(text.encode())
                    found.append(tokens.frequencies(text))
                lists.append(_lists(found))
            return [sizes, pa.concat_arrays(lists) if lists else pa.array([], pa.list_(_ENTRY))]

        return work

    return append_columns(docs, make, "n_bytes long, frequencies array<struct<token:string,times:int>>", text_col, keep)


def piece_table(seen: DataFrame, vocabulary: str) -> DataFrame:
    """(token, docs, pieces) of each distinct token of ``seen``, a row a document and token."""
    ship_package(seen.sparkSession)

    def count(batches):
        tokens = pre_tokens(vocabulary)
        for batch in batches:
            n = np.fromiter((tokens.pieces(t) for t in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["token", "docs", "pieces"])

    return seen.groupBy("token").agg(F.count("*").alias("docs")).mapInArrow(count, "token string, docs long, pieces long")


def most_frequent(table: DataFrame, rows: int = COMMON_ROWS, size: int = COMMON_BYTES) -> DataFrame:
    """Tokens of ``table`` (token, docs, pieces) from a number of documents on: the least, by steps, that keeps within ``rows`` and ``size``.

    The tokens of the next step are too many or too large to add, so a token that is left out is in
    no more documents than about 1.1 / ``rows`` of all rows (document, token), unless tokens are long.
    """
    step = F.floor(F.log2("docs") * STEPS)
    # A row a step: at most 64 * STEPS.
    found = table.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("token")).alias("size")).collect()
    least = None
    for at in sorted(found, key=lambda r: -r["step"]):
        rows, size = rows - at["rows"], size - at["size"]
        if rows < 0 or size < 0:
            break
        least = at["step"]
    return table.filter(F.lit(False) if least is None else step >= least)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text_col: str = "text", keep: list[str] | None = None, common_rows: int = COMMON_ROWS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``).

    ``vocabulary``: path of a byte-level BPE file of the tokenizers library. Null and empty texts
    count 0 bytes and 0 tokens. Special strings in a text count one token each, as the library
    does by default. Texts count whole, however long. Rows are independent: repeated rows and ids
    stay as they are, and columns of ``docs`` named like a new one give way. At most ``common_rows``
    pre-tokens, of the most documents, are broadcast; the join by shuffle that the others need
    gives the same sums.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    own = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)
    rows = docs.select(own.alias("row"), F.col(f"`{text_col}`").alias("text"))
    counted = stash(frequencies(rows, vocabulary, "text", ["row"]).withColumn("n", F.monotonically_increasing_id()), "frequencies", "zstd")
    seen = counted.select("n", F.inline("frequencies"))
    table = stash(piece_table(seen, vocabulary), "pieces", "zstd")
    common = most_frequent(table, common_rows)
    met = seen.join(F.broadcast(common.select("token", "pieces")), "token", "left")
    sums = met.filter("pieces is not null").groupBy("n").agg(F.sum(F.col("times") * F.col("pieces")).alias("tokens"))
    if common.count() < table.count():
        rare = met.filter("pieces is null").select("n", "token", "times").join(table.select("token", "pieces"), "token")
        sums = sums.unionByName(rare.groupBy("n").agg(F.sum(F.col("times") * F.col("pieces")).alias("tokens"))).groupBy("n").agg(F.sum("tokens").alias("tokens"))
    sums = stash(sums, "sums")
    discard(table)
    out = counted.select("row", "n_bytes", "n").join(sums, "n", "left").withColumn("n_tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    return out.select(*(["row.*"] if names else []), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
