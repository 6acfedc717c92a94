import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("wavequarry-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no driver tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows_of(frame):
    """Sorted rows as text, columns by name, of a pandas frame."""
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(duck):
    import pandas as pd

    def check(df, sql):
        got = df.toPandas()
        found = duck.execute(sql)
        want = pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
