import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    """Rows of a pandas frame as sorted texts, columns by name; nulls of any kind are alike, and whole numbers whether or not nulls made them floats."""
    frame = frame[sorted(frame.columns)].astype(object)
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(str(tuple(map(whole, r))) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def as_rows():
    return rows
