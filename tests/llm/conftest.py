from __future__ import annotations

import pytest
from llm_rows import ROWS, SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, a spliced passage, nulls, empty and long texts, repeats, columns that may clash."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
