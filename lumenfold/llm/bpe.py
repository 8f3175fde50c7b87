"""BPE encoding by dynamic programming over prefixes, and decoding.

The BPE encoding of a word has one last token for each of its prefixes: the token that ends the
encoding of that prefix. A token that matches a suffix of the prefix is that one exactly when BPE
keeps it apart from the last token of what precedes it, and so one test of token pairs a match
decides. Matches come from an automaton over the vocabulary; walking back from the end of the word
over the stored last tokens gives the ids.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenfold.llm.arrowtext import append_columns
from lumenfold.llm.token_count import byte_of_symbol

#: Words in either half of a worker's dictionary: what was not asked for while one half filled goes.
DICTIONARY_SIZE = 120_000
#: Entries of the table of tested token pairs, likewise.
PAIRS_SIZE = 150_000
_NEVER = 1 << 62


class PrefixBpe:
    """One BPE file of the tokenizers library whose words end in a marked symbol.

    Normalisation (NFC, white space, lower case) and the pattern of words are those of the file.
    """

    def __init__(self, path: str, size: int = DICTIONARY_SIZE):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.specials = list(specials)
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in specials.items()}
        self.born: dict[int, int] = {}  # the merge that makes a token; none for single symbols
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merge[a, b] = rank
            self.born.setdefault(made, rank)
            self.halves.setdefault(made, (a, b))
        to_byte = byte_of_symbol()
        self.inner, self.last = ahocorasick.Automaton(), {}
        for token, i in self.vocab.items():
            ends = len(token) > len(self.end) and token.endswith(self.end)
            plain = token[: -len(self.end)] if ends else token
            plain = bytes(map(to_byte.__getitem__, plain)).decode("latin-1")
            if ends:
                self.last[plain] = i
            else:
                self.inner.add_word(plain, (len(plain), i))
        self.inner.make_automaton()
        self.longest = max(map(len, self.last))
        self.special_ids = {text: np.array([i], "<u4").tobytes() for text, i in specials.items()}
        self.size, self.known, self.older, self.apart = size, {}, {}, {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' symbols in a row gives these two tokens.

        Undoes the merges inside the tokens that touch the seam, the latest first. While two
        symbols meet at the seam, a merge of them must come before either of them is taken up by
        its own side; of merges with one rank the left one comes first.
        """
        left_until = right_until = _NEVER
        born, halves, merge = self.born, self.halves, self.merge
        while True:
            rank = merge.get((left, right))
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            at, of = born.get(left, -1), born.get(right, -1)
            if at < 0 and of < 0:
                return True
            if at > of:
                left, left_until = halves[left][1], at
            else:
                right, right_until = halves[right][0], of

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the pattern, from the last tokens of its prefixes."""
        symbols = word.encode().decode("latin-1")
        n, apart = len(symbols), self.apart
        whole = self.last.get(symbols)
        if whole is not None and (whole in self.born or n == 1):
            return [whole]
        # By prefix: length and id of its last token.
        lengths, tokens = [0] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.inner.iter(symbols[:-1]):
            k = end + 1
            if lengths[k]:
                continue
            if length < k:
                pair = tokens[k - length] << 20 | token
                ok = apart.get(pair)
                if ok is None:
                    ok = apart[pair] = self.stays_apart(tokens[k - length], token)
                if not ok:
                    continue
            lengths[k], tokens[k] = length, token
        get = self.last.get
        for length in range(min(n, self.longest), 0, -1):
            token = get(symbols[n - length :])
            if token is not None:
                if length < n:
                    pair = tokens[n - length] << 20 | token
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.stays_apart(tokens[n - length], token)
                    if not ok:
                        continue
                lengths[n], tokens[n] = length, token
                break
        out, k = [], n
        while k:
            out.append(tokens[k])
            k -= lengths[k]
        if len(apart) > PAIRS_SIZE:
            apart.clear()
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """Words and special strings of ``text`` in order; white space is in none of them."""
        if not any(s in text for s in self.specials):
            return self.words.findall(self.folded(text))
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else self.words.findall(self.folded(part))
        return out

    @staticmethod
    def folded(text: str) -> str:
        """NFC and lower case, character by character (the library knows no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ids_of(self, word: str) -> bytes:
        """Ids of a word that the newer half of the dictionary does not hold."""
        found = self.older.get(word) or self.special_ids.get(word)
        if found is None:
            found = np.array(self.encode_word(word), "<u4").tobytes()
        if len(self.known) >= self.size:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        get, other = self.known.get, self.ids_of
        ids = b"".join([get(word) or other(word) for word in self.split(text)])
        return ids, self.decode(np.frombuffer(ids, "<u4"))

    def forget(self) -> None:
        """Empty the dictionaries: they would outlast the task in its worker."""
        self.known, self.older = {}, {}
        self.apart.clear()

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids: as the file names no decoder, its tokens with spaces between."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@functools.cache
def prefix_bpe(path: str) -> PrefixBpe:
    """One dictionary for all tasks of a Python worker."""
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens long, token_ids binary (little-endian 32-bit ids) and decoded string.

    ``vocabulary``: path of a BPE file of the tokenizers library with an end-of-word suffix. Null and
    empty texts have no ids and the empty decoded text. Special strings in a text become their ids.
    Rows are independent: repeated rows and ids stay, and columns of ``docs`` named like a new one
    give way.
    """

    def make():
        bpe = prefix_bpe(vocabulary)

        def work(texts: pa.Array) -> list:
            found = [bpe.encode(text) if (text := value.as_py()) else (b"", "") for value in texts]
            return [pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([i for i, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())]

        work.close = bpe.forget
        return work

    return append_columns(docs, make, "n_tokens long, token_ids binary, decoded string", text_col, keep)
