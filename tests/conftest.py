import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


def duck(sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same(df, con, sql, digits=9):
    """Rows of a Spark result and of a DuckDB query, columns by name, any order."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)

    def norm(v):
        if isinstance(v, float):
            return None if v != v else round(v, digits) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    key = lambda row: tuple((x is not None, str(x)) for x in row)
    a = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=key)
    b = sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert a == b
