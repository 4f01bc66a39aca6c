from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"

EDGES = [
    (0, None, None, None, None),
    (1, "", "en", "src1", 0),
    (2, " \t\n ", "en", "src1", 4),
    (3, "one", None, "src2", 3),
    (4, "the quick brown fox jumps over the lazy dog " * 9, "en", "src1", 396),
    (4, "the quick brown fox jumps over the lazy dog " * 9, "en", "src1", 396),
    (5, "the quick brown fox jumps over the lazy dog " * 9, "de", "src1", 396),
    (None, "text without an id", "en", "src3", 18),
    (7, "x" * 300_000, "en", "src1", 300_000),
    (8, "Ünïcode 😀 text", "de", None, 14),
]
EXTRA = "fp long, t string, spans string, bucket int, id long, h long, score string, lang_pred int, __text string, __id string, __n int, copies string, row string, root int, component_id string, held_out string, k string, n string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA

VALUES = [1 if x.split()[1] in ("int", "long") else "x" for x in EXTRA.split(", ")]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, long, equal and repeated texts, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *VALUES) for r in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
