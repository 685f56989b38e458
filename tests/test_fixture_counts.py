"""Row counts documented in FIXTURES.md §3 for the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from offerscope.functions import fixed
from offerscope.plans import ANALYSES, Tables, cleaning, load_all

load_all()

EXPECTED = {
    "dq_orphan_offer": 164,
    "dq_orphan_person": 213,
    "dq_informational_completed": 374,
    "dq_reward_mismatch": 20,
    "dq_completed_without_receipt": 1096,
    "dq_completed_after_expiry": 454,
    "dq_completed_unviewed": 1346,
    "dq_underspend_max": 34,
    "dq_underspend_rownum": 34,
    "dq_underspend_window": 114,
    "dq_overlapping_receipts": 1858,
    "dq_overlapping_receipts_alt": 1858,
    "cln_drop_superseded_receipts": 1430,
    "cln_drop_underspend_window": 23,
    "cln_drop_underspend_completion": 34,
    "cln_drop_underspend_lateral": 308,
    "kpi_inactive_customers": 7,
    "kpi_never_viewed": 7,
    "eda_age_outliers": 143,
    "eda_income_outliers": 130,
    "eda_amount_outliers": 88,
    "mul_rate_by_gender_offer_type": 6,
    "kpi_completion_by_viewer_speed": 3,
}


@pytest.fixture(scope="module")
def mid(spark):
    from conftest import SF_MID
    return Tables.from_testdata(spark, SF_MID)


def test_base_sizes(mid):
    assert mid.profile.count() == 1500
    assert mid.transcript.count() == 10000
    assert mid.events.count() == 9929
    counts = {r["event"]: r["n"] for r in mid.events.groupBy("event").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {fixed.OFFER_RECEIVED: 4256, fixed.OFFER_VIEWED: 1882, fixed.TRANSACTION: 1885,
                      fixed.OFFER_COMPLETED: 1906}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_documented_count(mid, name):
    assert ANALYSES[name](mid).count() == EXPECTED[name]


def test_ordered_chain_counts(mid):
    ev = mid.events
    after = [cleaning.clean_events(ev, mid.offers, steps=k) for k in (1, 2, 3, 4)]
    rec = after[0].filter(F.col("event") == fixed.OFFER_RECEIVED).count()
    comp = [a.filter(F.col("event") == fixed.OFFER_COMPLETED).count() for a in after[1:]]
    assert rec == 2826
    assert comp == [1883, 1859, 1598]


def test_expired_share_and_completion_hours(mid):
    r = ANALYSES["kpi_expired_pct"](mid).collect()[0]
    assert round(r["expired_pct"] * 4168) == 3248
    h = ANALYSES["kpi_avg_completion_hours"](mid).collect()[0][0]
    assert round(h, 6) == 146.807474


def test_profile_sums_and_correlation(mid):
    s = mid.profile_clean.agg(F.sum("income"), F.sum("age")).collect()[0]
    assert (s[0], s[1]) == (69557500.0, 51198)
    assert round(ANALYSES["mul_corr_age_income"](mid).collect()[0][0], 6) == -0.010791
