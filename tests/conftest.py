import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sluice.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("staging")),
        spark__sql__streaming__stateStore__providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    def collect(df, *cols):
        frame = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))

    return collect


@pytest.fixture
def plan(capsys):
    """The formatted physical plan of a DataFrame."""
    def text(df):
        df.explain("formatted")
        return capsys.readouterr().out

    return text
