from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from traitframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tables are tiny here: compiling code per query would take most of the time
    session = local_session(4, "tests", spark__sql__codegen__wholeStage="false", spark__sql__shuffle__partitions="2")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=lambda t: tuple((v is None, str(v)) for v in t))
