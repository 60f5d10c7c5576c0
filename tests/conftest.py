import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from heddlework.session import build_session  # noqa: E402
from heddlework.streaming.waits import STATE_STORE  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    conf = {key.replace(".", "__"): value for key, value in STATE_STORE.items()}
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false", **conf,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
