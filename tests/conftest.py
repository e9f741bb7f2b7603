import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rosterfold.checks.session import local_session  # noqa: E402
from rosterfold.operators.workspace import clear  # noqa: E402

HEAVY = {"spark.rosterfold.rowsPerTask": "6", "spark.sql.autoBroadcastJoinThreshold": "-1"}


# Made at import, so that test modules can hold column expressions.
SESSION = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="rosterfold-tests-")})


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    clear(SESSION)
    SESSION.stop()


@pytest.fixture
def heavy(spark):
    """Settings under which a key of seven rows already counts as heavy and nothing is broadcast by size."""
    before = {key: spark.conf.get(key, None) for key in HEAVY}
    for key, value in HEAVY.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(params=["ordinary", "heavy"])
def either(request):
    """The session, once with ordinary settings and once with every larger key treated as heavy."""
    return request.getfixturevalue("spark" if request.param == "ordinary" else "heavy")
