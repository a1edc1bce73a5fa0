import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(i, t, *rest, *[None] * (2 - len(rest)), len(t or "")) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """A table with further columns, of names that the operators use inside."""

    def make(df):
        names = "key n row rank part size found words frag lines label_ bucket position passes target kept".split()
        return df.selectExpr("*", *[f"doc_id AS {name}" for name in names if name not in df.columns])

    return make
