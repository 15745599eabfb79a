import pytest

from tallywarden.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
