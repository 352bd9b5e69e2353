import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import FOLDER  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    text = " ".join(f"word{i % 97}x{i % 13}" for i in range(4000))
    rows = [
        (1, text, "en", 1),
        (2, text, None, 2),
        (2, text, None, 2),
        (None, text, "de", None),
        (None, None, None, None),
        (3, None, "en", 3),
        (4, "", "en", 3),
        (5, " \t\n ", "en", 3),
        (6, "one two three", "en", 3),
        (7, "one  two\tthree", "en", 3),
        (8, "x" * 20_000, "en", 3),
        (9, "a \U0001f600 é\x00b #tag # tag", "en", 3),
    ]
    # columns named like things the operators add
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, shard int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
