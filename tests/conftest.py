import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from reviewlake.schemas import SCHEMAS, evolve  # noqa: E402
from reviewlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(table, {...}, {...})``: a frame of a declared table, other columns zero."""

    def make(table, *dicts):
        schema = SCHEMAS[table]
        types = {f.name: f.dataType for f in schema}
        names = sorted({k for d in dicts for k in d}) or ["repo"]
        shape = ", ".join(f"`{n}` {types[n].simpleString()}" for n in names)
        data = [tuple(d.get(n, "" if types[n].simpleString() == "string" else 0) for n in names) for d in dicts]
        return evolve(spark.createDataFrame(data, shape), schema)

    return make
