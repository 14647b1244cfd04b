import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="session")
def tokenizer():
    return TOKENIZER


# One of each: nulls, empty and blank texts, ties, repeated rows, a very long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a", 5),
    (2, None, "en", "a", 1),
    (3, "", None, None, None),
    (4, " \t\n", "de", "b", 2),
    (None, "No id here, but words. And more of them, for good measure", "en", None, 3),
    (5, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "b", 5),
    (6, "same row", "de", "b", 4),
    (6, "same row", "de", "b", 4),
    (7, "Straße ÉCOLE naïve 東京 12,5% don't <|endoftext|> é \x1c a b ΟΔΟΣ 🙂", "fr", "c", 6),
    (8, "word " * 60_000, "en", "a", 7),
    (9, "x" * 30_000, "en", "c", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"  # `score` clashes with results


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(data_dir="/root/testdata/sf0.001"):
    return os.environ.get("TEST_SF_DIR", data_dir)
