from __future__ import annotations

import pytest
from cases import ODD_TEXTS, read


@pytest.fixture(scope="session")
def small_docs() -> list[tuple]:
    """(doc_id, text, lang) of the smallest table, and odd rows."""
    return read("documents", "doc_id, text, lang") + [(i, t, "en") for i, t in ODD_TEXTS]


@pytest.fixture(scope="session")
def docs(spark, small_docs):
    """The same rows with columns whose names clash with those of the operators' results."""
    rows = [(*r, "a", None, 7) for r in small_docs]
    schema = "doc_id long, text string, lang string, source string, held_out string, n_words long"
    return spark.createDataFrame(rows, schema).repartition(5, "source", "text")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
