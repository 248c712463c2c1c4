"""A small local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT)]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from docloom.session import get_spark

    session = get_spark("tests", cores=int(os.environ.get("TEST_CORES", "4")), spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    """The smallest driver tables."""
    path = f"{DATA}/sf0.001"
    if not Path(path).is_dir():
        pytest.skip("no driver tables here")
    return path
