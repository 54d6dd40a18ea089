import datetime as dt
import tempfile

import pytest

from barloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def sessions(n, first="2024-01-01"):
    """n weekdays from a start date."""
    day, out = dt.date.fromisoformat(first), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture
def make_bars(spark):
    def make(closes, symbol="AAA", first="2024-01-01"):
        rows = [(symbol, d, float(c) * 0.99, float(c) * 1.02, float(c) * 0.97, float(c), 1000.0 + i)
                for i, (d, c) in enumerate(zip(sessions(len(closes), first), closes))]
        return spark.createDataFrame(rows, SCHEMA)
    return make
