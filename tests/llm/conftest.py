import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows in a table that has extra columns with names the operators use themselves."""
    rows = [(i, t, lang, 1, 2, "x", 3) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, at int, version string, rep int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
