import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from cases import TEXTS  # noqa: E402
from panelspark.session import ship  # noqa: E402

@pytest.fixture(scope="session", autouse=True)
def library(spark):
    ship(spark)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", n, True, "r", 1.5, 3, "b", None) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, kept boolean, row string, score double, "
                                       "flag int, bucket string, spans string").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
