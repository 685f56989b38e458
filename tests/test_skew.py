"""A third of all events moved onto one person: results stay exact and the
per-key groups the windows see stay bounded by the number of distinct hours."""

import pytest
from pyspark.sql import functions as F

from offerscope.plans import ANALYSES, ORACLES, Tables, load_all
from offerscope.sources import fixtures

load_all()

HEAVY = ["dq_underspend_window", "dq_underspend_max", "dq_overlapping_receipts", "dq_completed_unviewed",
         "dq_completed_after_expiry_ctx", "cln_drop_superseded_receipts", "cln_drop_underspend_lateral",
         "cln_final_events", "kpi_completion_by_viewer_speed", "kpi_spend_by_gender",
         "mul_rate_by_age_income", "eda_txn_per_person", "kpi_inactive_customers"]


def _skew(events):
    return events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


@pytest.fixture(scope="module")
def skewed(spark):
    from conftest import SF_MID
    ev = _skew(spark.read.parquet(f"{SF_MID}/events.parquet"))
    cu = spark.read.parquet(f"{SF_MID}/customer.parquet")
    raw = fixtures.raw_tables_from(spark, ev, cu)
    return Tables(raw.portfolio, raw.profile, raw.transcript)


@pytest.fixture(scope="module")
def duck_skewed():
    import duckdb
    from conftest import SF_MID
    con = duckdb.connect()
    con.sql(f"""CREATE VIEW events AS SELECT event_id, ts,
                CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, value, props
                FROM read_parquet('{SF_MID}/events.parquet')""")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{SF_MID}/customer.parquet')")
    return con


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", HEAVY)
def test_skewed_matches_oracle(skewed, duck_skewed, name):
    df = ANALYSES[name](skewed)
    rel = duck_skewed.sql(ORACLES[name])
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


def test_hot_person_is_a_third(skewed):
    n = skewed.flat.count()
    hot = skewed.flat.filter(F.col("person") == "person_0").count()
    assert hot * 3 >= n


def test_window_groups_bounded_by_time_domain(skewed):
    """However many rows a person has, a lifecycle window partition holds at
    most one row per distinct hour."""
    hours = skewed.flat.select("time").distinct().count()
    from offerscope.operators import lifecycle as lc
    biggest = lc.event_keys(skewed.flat).groupBy("person", "offer_id").count().agg(F.max("count")).collect()[0][0]
    assert biggest <= hours
    raw_biggest = skewed.flat.groupBy("person", "offer_id").count().agg(F.max("count")).collect()[0][0]
    assert raw_biggest > biggest
