import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_tools import prose  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows, with more columns whose names clash with the operators' own."""

    def of(rows, extra=True):
        full = [(i, t, "en" if k % 3 else None, f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("key", "h", "c", "v", "token", "n", "row", "kept", "spans", "removed", "f", "q", "start", "score", "label"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return of


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, very long texts, repeated rows and ties."""
    long = prose(1, 30_000, 5000)
    a = "\n".join(prose(k, 30) for k in range(2, 8))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, a), (5, a), (6, a), (None, a), (None, None), (7, "one"), (8, "one two"), (9, "One TWO"), (10, "x" * 50_000), (11, "é 😀 日本語\x1c\x85\xa0 ß İ Σς"), (12, long + " tail")]
