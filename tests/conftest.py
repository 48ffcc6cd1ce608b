import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from innkeep.session import get_session
    s = get_session("local[4]", shuffle_partitions=4,
                    extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="innkeep-wh-")})
    yield s


@pytest.fixture(scope="session")
def duck():
    from innkeep.oracle.compare import duck_connect
    return duck_connect(SF_SMALL)


@pytest.fixture(scope="session")
def fx(spark):
    from innkeep.sources.fixtures import Fixtures
    return Fixtures(spark, SF_SMALL)
