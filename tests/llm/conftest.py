import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from episode_audit.llm.common import prepared  # noqa: E402
from episode_audit.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return prepared(local_session(cores="4", shuffle_partitions=4))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 0.5, None),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "b", 2, None, None, "t"),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "a", 0, "x", 0.1, "t"),
        (5, "   \n\t\n ", "de", "a", 0, "x", 0.1, "t"),
        (6, long, "en", "b", 9, "x", 0.1, "t"),
        (7, long + " end", "en", "b", 9, "x", 0.1, "t"),
        (7, long + " end", "en", "b", 9, "x", 0.1, "t"),
        (None, "no id here at all but words", "en", "b", 9, "x", 0.1, "t"),
        (8, "café 日本 \U0001f642 ▁ x", "fr", None, 3, "x", 0.1, "t"),
        (9, "two words", "en", "c", 2, "x", 0.1, "t"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, Position string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
