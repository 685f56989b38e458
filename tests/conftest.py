import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from offerscope.session import local_session
    warehouse = tempfile.mkdtemp(prefix="offerscope-warehouse-", dir="/tmp")
    session = local_session(cores="*", shuffle_partitions=8, app="offerscope-tests", driver_memory="4g",
                            extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from offerscope.plans import Tables
    return Tables.from_testdata(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["events", "customer"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
