import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from listwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as a sorted list of tuples."""

    def collect(df, *cols):
        found = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(found, key=lambda r: tuple((x is not None, str(x)) for x in r))

    return collect
