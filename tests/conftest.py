import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lodespark.session import ship

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return "~" if value is None else str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its SQL on the smallest tables."""
    import duckdb

    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(query, sql):
        df = query(spark, str(DATA))
        columns = sorted(df.columns)
        ours = sorted(tuple(map(_plain, row)) for row in df.select(*columns).collect())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert ours == sorted(tuple(_plain(row[i]) for i in order) for row in result.fetchall())

    return check
