import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from eavesgraph.session import build_session

    s = build_session("local[4]", 4, "tests")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""
    return lambda df, *c: sorted((tuple(r) for r in (df.select(*c) if c else df).collect()), key=str)
