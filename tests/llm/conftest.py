"""Small tables for the operators' edge cases, and the smallest given table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
LONG = ("lorem ipsum dolor sit amet " * 9000) + "end"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "The first text. It has a few words, and some more of them.", "en", "a", "x", 0.5, 7),
        (1, "The first text. It has a few words, and some more of them.", "en", "a", "x", 0.5, 7),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", "", 0.0, 0),
        (4, LONG, "en", "b", "x", 0.1, 1),
        (None, "A text without an id <|endoftext|> but with one special string.", None, "b", "x", 0.1, 1),
        (5, " \t\n\r\x0b\x0c ", "fr", "b", "x", 0.1, 1),
        (6, "noël café \U0001f600 123 a@b.co +1 (555) 123-4567", "fr", None, "x", 0.1, 1),
        (1, "Another text with an id that is there already.", "de", "a", "x", 0.1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score double, n_tokens int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
