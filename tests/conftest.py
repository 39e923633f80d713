import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallylog.session import get_spark  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests", "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection with the smallest tables as views."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in sorted((DATA / "sf0.001").glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
