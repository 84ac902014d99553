import pytest

from almanac.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", spark_master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
