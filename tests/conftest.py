import pytest

from nearvote.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    session = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{root}/checkpoint", spark__sql__warehouse__dir=f"{root}/warehouse", spark__ui__showConsoleProgress="false")
    yield session
    session.stop()
