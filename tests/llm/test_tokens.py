"""Token counts and BPE against the library; other columns and odd texts pass through."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import bpe, queries, token_count

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def test_counts_equal_the_library(spark, docs, sf, byte_library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op9_token_counts(spark, sf).collect():
        n = len(byte_library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_ids_and_decoded_text_equal_the_library(spark, docs, sf, word_library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op10_prefix_bpe(spark, sf).collect():
        ids = word_library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rare_pre_tokens_meet_by_shuffle(docs, odd):
    """With few broadcast pre-tokens, or none, the counts are the same."""
    for table in (docs, odd):
        want = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(table, BYTES, keep=["doc_id"]).collect())
        for common in (0, 50):
            assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(table, BYTES, keep=["doc_id"], common_rows=common).collect()) == want


def test_broadcast_pre_tokens_are_the_most_frequent_within_both_bounds(spark):
    """Tokens are cut by steps of their documents, exactly, however many share a number; no token at all is a cut too."""
    docs = [1] * 500 + [2] * 40 + [64] * 3 + [900] * 2 + [10**9]
    table = spark.createDataFrame([("x" * (i % 7 + 1), n, 1) for i, n in enumerate(docs)], "token string, docs long, pieces long")

    def least(rows, size):
        found = [r.docs for r in token_count.most_frequent(table, rows, size).collect()]
        assert sorted(found) == sorted(n for n in docs if found and n >= min(found))
        return len(found)

    assert [least(n, 1 << 20) for n in (0, 1, 2, 3, 6, 45, 46, 545, 546)] == [0, 1, 1, 3, 6, 6, 46, 46, 546]
    sizes = [sum(i % 7 + 1 for i, n in enumerate(docs) if n >= k) for k in (900, 64)]
    assert [least(1000, x) for x in (0, sizes[0], sizes[1] - 1, sizes[1])] == [0, 3, 3, 6]
    assert token_count.most_frequent(table.limit(0)).count() == 0


def test_odd_rows(odd, byte_library, word_library):
    counted = token_count.count_tokens(odd, BYTES).collect()
    assert len(counted) == 9 and set(counted[0].asDict()) == {"doc_id", "text", "lang", "source", "kept", "score", "n_bytes", "n_tokens", "over_limit"}
    for r in counted:
        assert r.n_tokens == len(byte_library.encode(r.text or "", add_special_tokens=False).ids)
    for r in bpe.encode_decode(odd, WORDS).collect():
        ids = word_library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == word_library.decode(ids, skip_special_tokens=False)


def test_empty_table(empty):
    assert token_count.count_tokens(empty, BYTES).count() == 0
    assert bpe.encode_decode(empty, WORDS).count() == 0


def test_decoding_ids_gives_the_decoded_text():
    coder = bpe.prefix_bpe(WORDS)
    ids, text = coder.encode("Round trips keep their words.")
    assert coder.decode(np.frombuffer(ids, "<u4")) == text


def test_small_dictionaries_change_nothing():
    tight = bpe.PrefixBpe(WORDS, size=3)
    words = "one two three four five six seven one two three"
    assert [tight.encode(words) for _ in range(3)] == [bpe.prefix_bpe(WORDS).encode(words)] * 3
