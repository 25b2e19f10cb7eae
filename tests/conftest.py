import pytest

from tidewatch.session import local, ship


@pytest.fixture(scope="session")
def spark():
    s = local(8, spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
