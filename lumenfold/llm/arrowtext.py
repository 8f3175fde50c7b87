"""Text columns inside tasks: Arrow batches, and words as NumPy arrays over their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.session import ship_package

#: The separators of words: space, and \t \n \v \f \r.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one step of NumPy work takes at most, but for single longer documents.
STEP_BYTES = 1 << 20
#: Rows whose new columns go back to Spark at once, where the text itself does not.
STEP_ROWS = 512

_WORD = np.ones(256, bool)
_WORD[list(SEPARATORS)] = False
_SAME = np.arange(256, dtype=np.uint8)
ASCII_LOWER = _SAME.copy()
ASCII_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTE_KEYS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return the memory of what a worker is done with to the system: workers outlast their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def append_columns(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns ``fields``, a DDL string.

    ``make`` runs once per task and gives a function from the Arrow array of texts to the arrays
    of the new columns, whose attribute close(), if there is one, is called at the task's end. A column of ``docs`` that has the name of a new one gives way to it.
    """
    ship_package(docs.sparkSession)
    new = T._parse_datatype_string(fields)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    text = F.col(f"`{text_col}`").cast("string")

    def arrays(columns: list) -> list[pa.Array]:
        return [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]

    if text_col in kept:
        # The text stays on the JVM's side; only the new columns come back.
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            work = make()
            for some in texts:
                yield pa.StructArray.from_arrays(arrays(work(some)), names=new.names)
                give_back()
            getattr(work, "close", int)()
            give_back()

        run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        # Not to be computed once more for each filter on a new column.
        made = F.arrow_udf(run, new).asNondeterministic()
        return docs.select(*[F.col(f"`{c}`") for c in kept], made(text).alias("__new")).select(*[F.col(f"`{c}`") for c in kept], "__new.*")

    schema = T.StructType([docs.schema[c] for c in kept] + list(new))
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("__text"))
    n = len(kept)

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for k in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(k, STEP_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + arrays(work(batch.column(n))), names=kept + new.names)
            give_back()
        getattr(work, "close", int)()
        give_back()

    return source.mapInArrow(run_batches, schema)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the offsets of the texts in them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of consecutive texts with about ``most`` bytes together."""
    body, at = flat(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, body[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_bounds(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``body``, and the index of each document's first word (and the end)."""
    inside = _WORD[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    before = np.empty(len(body), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(body), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _SAME) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, after the byte map ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    data = body[np.repeat(starts, lengths) + inside]
    value = _BYTE_KEYS[fold[data]] * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of several hashes."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the index of each document's first one (and the end).

    A document with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    short = (counts > 0) & (counts < width)
    n = np.where(counts >= width, counts - width + 1, short.astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][doc] + np.arange(int(begin[-1])) - begin[:-1][doc]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = combine(*[padded[at + k] for k in range(width)]) if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(short):
        own = words[first[i] : first[i + 1]]
        out[begin[i]] = combine(np.array([len(own)], np.uint64), *[own[k : k + 1] for k in range(len(own))])[0]
    return out, begin
