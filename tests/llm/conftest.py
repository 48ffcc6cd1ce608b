import datetime  # noqa: F401

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=""):
        """rows: (doc_id, text, lang, source, *extra values)"""
        full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), *r[4:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra).repartition(3)
    return make
