import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def documents(spark):
    return sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and extra columns whose names clash with results."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, 1, "x", None),
        (2, "", "a", "en", 2, None, 5),
        (None, "a b c d", "a", None, 3, "y", 6),
        (None, "a b c d", "b", "de", 3, "y", 6),
        (7, "x y " * 60, "b", "en", 4, "z", 7),
        (7, "x y " * 60, "b", "en", 4, "z", 7),
        (9, "X  Y", "", "en", 5, "", 8),
        (10, long, "a", "en", 6, "", 9),
        (11, long + " tail", "a", "fr", 7, "", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, component_id string, size int")
