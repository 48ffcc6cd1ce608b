"""Differential test: every registered key against its DuckDB statement on
the same parquet tables (sf0.001 here; the driver runs sf0.01)."""

import pytest

from innkeep.oracle.compare import compare
from innkeep.registry import ORACLE, QUERIES, load_all

load_all()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(key, fx, duck):
    ok, msg = compare(QUERIES[key](fx), ORACLE[key], duck)
    assert ok, msg


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_keys_run(key, fx):
    assert QUERIES[key](fx).count() >= 0


def test_every_key_has_oracle_but_documents():
    assert set(QUERIES) - set(ORACLE) == {"write_documents"}
