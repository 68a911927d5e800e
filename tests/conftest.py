import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Run a registered query and its SQL over the smallest tables; both as sorted rows."""
    import duckdb

    import __spark_entry__ as entry
    from quillon.sources.views import TABLES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return v

    def run(name):
        df = entry.queries()[name](spark, SMALL)
        cols = sorted(df.columns)
        ours = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
        rel = db.sql(entry.oracle_sql()[name])
        at = [rel.columns.index(x) for x in cols]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        return ours, theirs

    return run
