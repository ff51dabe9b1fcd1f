import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from millrace.session import session  # noqa: E402

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return session("millrace-tests", cores=4, shuffle_partitions=4, spark__driver__memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.is_dir():
        pytest.skip("the driver's tables are not here")
    return str(DATA)
