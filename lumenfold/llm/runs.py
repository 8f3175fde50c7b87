"""Periodic runs of words, by catchers over blocks whose lengths are powers of two.

Every block of 2 ** k words that begins at a multiple of its length is a catcher once it is complete. While words are
appended, the suffix of as many words is compared with the one catcher of each size that begins one to two
of its lengths before that suffix: an equality is a repetition whose period lies between the catcher's length and
twice it. A run of four periods has a catcher of its size in its first period, so a catcher needs to
report only repetitions that go on for three periods. New ones are extended to both sides and
merge into runs; what lies in a run that smaller catchers found has that run's period.

All catchers of one size in a step of texts are compared at once, with hashes of windows that double from
size to size; a window's hash is that of its halves in order, so no sums of powers can cancel out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrowtext import append_columns, combine, steps, word_bounds, word_hashes

#: A run has so many periods, and words, at least.
LEAST_PERIODS, LEAST_WORDS = 4, 6


class Windows:
    """Hashes of the windows of 2 ** k words at every place, for the sizes asked for so far."""

    def __init__(self, words: np.ndarray):
        self.sizes = [words]

    def of(self, k: int) -> np.ndarray:
        while len(self.sizes) <= k:
            last, half = self.sizes[-1], 1 << (len(self.sizes) - 1)
            self.sizes.append(combine(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.sizes[k]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on agree, ``most`` at most."""
        found = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            same, at = self.of(k), np.flatnonzero(found + (1 << k) <= most)
            ok = at[same[a[at] + found[at]] == same[b[at] + found[at]]]
            found[ok] += 1 << k
        return found

    def common_before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words that end before ``a`` and before ``b`` agree, ``most`` at most."""
        found = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            same, at = self.of(k), np.flatnonzero(found + (1 << k) <= most)
            ok = at[same[a[at] - found[at] - (1 << k)] == same[b[at] - found[at] - (1 << k)]]
            found[ok] += 1 << k
        return found


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, an n x 3 array by start, then period.

    ``words``: hashes of the words of several documents end to end, of which document i has those from
    ``first[i]`` to ``first[i + 1]``; starts count from the first word of all.
    """
    n, lengths = len(words), np.diff(first)
    top = int(lengths.max(initial=0))
    windows = Windows(words)
    begin, end = np.repeat(first[:-1], lengths), np.repeat(first[1:], lengths)
    runs = np.zeros((0, 3), np.int64)
    reach = np.zeros(0, np.int64)  # of the runs so far, by start: the furthest end up to each
    k = 0
    while LEAST_PERIODS << k <= top:
        h, same = 1 << k, windows.of(k)
        at = np.arange(h, len(same))
        catcher = (at // h - 1) * h
        hit = np.flatnonzero(same[at] == same[catcher])
        b, q = catcher[hit], at[hit] - catcher[hit]
        ok = b + 3 * q <= end[b]
        if k:
            # Inside a run of smaller catchers there is nothing new.
            place = np.searchsorted(runs[:, 0], b, "right") - 1
            ok &= (place < 0) | (reach[place] < b + 3 * q) if len(runs) else True
        b, q = b[ok], q[ok]
        full = windows.common(b, b + q, 2 * q) == 2 * q if len(b) else np.zeros(0, bool)
        b, q = b[full], q[full]
        if len(b):
            right = b + q + windows.common(b, b + q, end[b] - b - q)
            left = b - windows.common_before(b, b + q, b - begin[b])
            found = np.unique(np.stack([left, right - left, q], 1), axis=0)
            found = found[found[:, 1] >= np.maximum(LEAST_PERIODS * found[:, 2], LEAST_WORDS)]
            # The same words with a multiple of a smaller period are that period's run.
            found = found[np.unique(found[:, :2], axis=0, return_index=True)[1]]
            both = np.concatenate([runs, found])
            runs = both[np.lexsort((both[:, 2], both[:, 0]))]
            reach = np.maximum.accumulate(runs[:, 0] + runs[:, 1])
        k += 1
    return runs


def dropped_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` words is in a run beyond that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _work(texts: pa.Array) -> list:
    n_words, runs, collapsed = [], [], []
    for _, _, body, at in steps(texts):
        starts, ends, first = word_bounds(body, at)
        hashes = word_hashes(body, starts, ends)
        counts = np.diff(first)
        n_words.append(counts)
        # Documents of like length together, so that large catchers see long documents only.
        classes = np.frexp(counts)[1]
        of_doc: dict[int, np.ndarray] = {}
        for c in np.unique(classes[counts >= LEAST_WORDS]):
            docs = np.flatnonzero(classes == c)
            own = np.concatenate([[0], np.cumsum(counts[docs])])
            words = hashes[np.repeat(first[docs] - own[:-1], counts[docs]) + np.arange(own[-1])]
            found = find_runs(words, own)
            if len(found):
                doc = np.searchsorted(own, found[:, 0], "right") - 1
                found[:, 0] -= own[doc]
                cuts = np.flatnonzero(np.diff(doc)) + 1
                of_doc |= dict(zip(docs[doc[np.concatenate([[0], cuts])]].tolist(), np.split(found, cuts), strict=True))
        whole = body.tobytes()
        for i in range(len(counts)):
            words = whole[at[i] : at[i + 1]].split()
            found = of_doc.get(i)
            if found is None:
                runs.append([])
            else:
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                words = [w for w, gone in zip(words, dropped_words(found, len(words)).tolist(), strict=True) if not gone]
            collapsed.append(b" ".join(words))
    return [pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()), pa.array(runs, _RUN_TYPE), pa.array(collapsed, pa.binary()).cast(pa.string())]


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words long, runs (start, length, period in words; by start, then period) and collapsed string.

    Words are what white space (space, \\t \\n \\v \\f \\r) parts. A run is a stretch of words with a smallest
    period of which it has four at least, and six words, that no neighbouring word extends. ``collapsed``: the
    words joined by single spaces, without those in a run beyond its first period. Null and empty texts have no
    words and collapse to the empty text. Texts count whole, however long. Rows are independent: repeated
    rows and ids stay, an empty table gives none, and columns of ``docs`` named like a new one give way.
    """
    return append_columns(docs, lambda: _work, f"n_words long, runs {_RUNS}, collapsed string", text_col, keep)


def most_periodic(runs: str | Column) -> Column:
    """Of ``runs`` by start, then period, the first with the most periods, exactly compared; null if there are none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def run_text(runs: str | Column) -> Column:
    """``start,length,period`` and a line feed of each run."""
    return F.concat(F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
