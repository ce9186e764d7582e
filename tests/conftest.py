import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pulsecart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "pulsecart-tests",
        master="local[8]",
        shuffle_partitions=2,
        **{
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
            "spark__driver__memory": "6g",
            "spark__ui__showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
