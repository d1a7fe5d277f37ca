import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from isohyet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def days(first: str, count: int):
    start = datetime.date.fromisoformat(first)
    return [start + datetime.timedelta(days=i) for i in range(count)]


def months(first_year: int, count: int):
    return [datetime.date(first_year + i // 12, i % 12 + 1, 1) for i in range(count)]


def daily(spark, values, first="2000-01-01", cell=1):
    rows = [(cell, d, v) for d, v in zip(days(first, len(values)), values)]
    return spark.createDataFrame(rows, "cell_id bigint, date date, value double")


def explain(df):
    """The formatted plan as text."""
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
