import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    # the folder that operators keep their intermediate tables in; gone after the tests
    folder = tempfile.mkdtemp(prefix="corpuslake-tests-")
    session = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[*]")).config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9))
    return repr(value)


@pytest.fixture
def agree(spark, duck):
    """Rows of a query and of its SQL are the same."""

    def check(frame, sql):
        columns = sorted(frame.columns)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
        ours = sorted(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
        assert len(ours) == len(theirs)
        assert ours == theirs

    return check
