from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from voxtally.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle=4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def folder():
    if not pathlib.Path(FOLDER).is_dir():
        pytest.skip("test tables are not here")
    return FOLDER
