"""Every fixture view built with the DataFrame API equals its SQL definition."""

import pytest

from innkeep.oracle.compare import compare
from innkeep.oracle.views import VIEW_ORDER, with_views

VIEWS = [v for v in VIEW_ORDER if v != "dim_n"]


@pytest.mark.parametrize("name", VIEWS)
def test_view_matches_sql(name, fx, duck):
    ok, msg = compare(fx.table(name), with_views(f"SELECT * FROM {name}"), duck)
    assert ok, msg
