import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = Path(os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    """Numbers to 8 digits, moved by a hair first, so that sums in another order don't fall on two sides of a half."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return value
    number = float(value)
    return None if number != number else float(f"{number * (1 + 1e-10):.8g}")


def rows(table) -> list[tuple]:
    """Rows of an Arrow table in one order, columns by name, numbers to 8 digits."""
    names = sorted(table.column_names)
    return sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, data, duck):
    def check(query, sql):
        mine, theirs = query(spark, data).toArrow(), duck.sql(sql).to_arrow_table()
        assert sorted(mine.column_names) == sorted(theirs.column_names)
        assert rows(mine) == rows(theirs)

    return check
