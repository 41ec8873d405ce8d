import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def against():
    """Compare a query with its SQL on the smallest tables, row by row."""
    import duckdb

    sf = "/root/testdata/sf0.001"

    def compare(spark, query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
        db = duckdb.connect()
        for f in os.listdir(sf):
            db.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)
        close = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert list(map(close, mine)) == list(map(close, theirs))

    return compare
