"""Hand-written micro cases (at most ten rows) for the semantics that bite."""

import pytest

from offerscope import schemas
from offerscope.functions import fixed
from offerscope.functions import text as T
from offerscope.operators import impute, prepare, profiling
from offerscope.operators import lifecycle as lc
from offerscope.operators.spend import window_spend
from offerscope.plans import cleaning, kpis, quality

R, V, X, C = fixed.OFFER_RECEIVED, fixed.OFFER_VIEWED, fixed.TRANSACTION, fixed.OFFER_COMPLETED


@pytest.fixture(scope="module")
def offers(spark):
    rows = [("o1", 5, 10, 1.0, "bogo", ["web"]), ("o2", 0, 0, 1.0, "informational", ["email"])]
    return prepare.onehot_channels(spark.createDataFrame(rows, schemas.PORTFOLIO))


def ev(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENTS)


def keyset(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1. receipt and completion in the same hour
def test_same_hour_counts_as_received(spark, offers):
    e = ev(spark, [("p", R, 10, "o1", None, None), ("p", C, 10, "o1", None, 5.0)])
    assert quality.completed_without_receipt(e, offers).count() == 0
    assert quality.completed_after_expiry(e, offers).count() == 0


# 2. completion exactly at expiry is valid; one hour later is expired
def test_expiry_bound_inclusive(spark, offers):
    on_time = ev(spark, [("p", R, 0, "o1", None, None), ("p", C, 24, "o1", None, 5.0)])
    late = ev(spark, [("p", R, 0, "o1", None, None), ("p", C, 25, "o1", None, 5.0)])
    assert quality.completed_after_expiry(on_time, offers).count() == 0
    assert keyset(quality.completed_after_expiry(late, offers), "completed_time", "received_time") == [(25, 0)]
    assert quality.completed_without_receipt(late, offers).count() == 1


# 3. latest receipt wins; a receipt exactly at the previous end is no overlap
def test_latest_receipt_and_strict_overlap(spark, offers):
    e = ev(spark, [("p", R, 0, "o1", None, None), ("p", R, 24, "o1", None, None),
                   ("p", C, 30, "o1", None, 5.0)])
    frame = lc.lifecycle(e)
    comp = frame.filter("is_completed").collect()[0]
    assert comp["last_received"] == 24
    assert quality.overlapping_receipts(e, offers).count() == 0
    e2 = ev(spark, [("p", R, 0, "o1", None, None), ("p", R, 23, "o1", None, None)])
    assert keyset(quality.overlapping_receipts(e2, offers), "first_received", "overlapping_received") == [(0, 23)]
    assert keyset(cleaning.superseded_receipts(e2, offers), "first_received") == [(0,)]


# 4. no transaction in the window: NULL spend is never below difficulty; 0 is
def test_missing_spend(spark, offers):
    e = ev(spark, [("p", R, 0, "o1", None, None), ("p", C, 6, "o1", None, 5.0)])
    assert quality.underspend(e, offers).count() == 0
    flagged = quality.underspend(e, offers, missing_spend_as_zero=True).collect()
    assert [r["total_spent"] for r in flagged] == [0.0]


# 5. spend 9.6 against difficulty 10: round(0) -> 10 (not flagged), round(2) -> 9.6 (flagged)
def test_rounding_changes_result(spark, offers):
    e = ev(spark, [("p", R, 0, "o1", None, None), ("p", X, 3, None, 4.8, None),
                   ("p", X, 4, None, 4.8, None), ("p", C, 6, "o1", None, 5.0)])
    assert quality.underspend(e, offers, spend_scale=0).count() == 0
    assert [r["total_spent"] for r in quality.underspend(e, offers, spend_scale=2).collect()] == [9.6]


def test_window_spend_bounds(spark):
    txns = ev(spark, [("p", X, 0, None, 1.0, None), ("p", X, 5, None, 2.0, None),
                      ("p", X, 10, None, 4.0, None), ("q", X, 5, None, 8.0, None)])
    iv = spark.createDataFrame([("p", 0, 10.0), ("p", 1, 9.5), ("p", 5, 5.0), ("p", 11, 20.0), ("q", 6, 2.0)],
                               "person string, a int, b double")
    got = {(r["a"], r["b"]): (r["spend"], r["n_txn"]) for r in window_spend(iv, txns, "a", "b").collect()}
    assert got[(0, 10.0)][1] == 3 and float(got[(0, 10.0)][0]) == 7.0
    assert float(got[(1, 9.5)][0]) == 2.0
    assert float(got[(5, 5.0)][0]) == 2.0
    assert got[(11, 20.0)] == (None, 0)
    assert got[(6, 2.0)] == (None, 0)


# 6. duplicates equal in NULL columns collapse
def test_dedupe_nulls_equal(spark):
    e = ev(spark, [("p", R, 0, "o1", None, None), ("p", R, 0, "o1", None, None), ("p", X, 0, None, 1.0, None)])
    assert prepare.dedupe_events(e).count() == 2


def test_duplicate_completion_multiplicity(spark, offers):
    # two completion events at one key with different rewards: the 'rows'
    # variant counts the window spend twice, the per-key variant once
    e = ev(spark, [("p", R, 0, "o1", None, None), ("p", X, 1, None, 3.0, None),
                   ("p", C, 2, "o1", None, 5.0), ("p", C, 2, "o1", None, 99.0)])
    once = quality.underspend(e, offers).collect()
    twice = quality.underspend(e, offers, multiplicity="rows").collect()
    assert [r["total_spent"] for r in once] == [3.0]
    assert [r["total_spent"] for r in twice] == [6.0]
    assert quality.completed_unviewed(e).count() == 2


# 7. null count with no NULLs is NULL
def test_null_count_is_null_not_zero(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert df.agg(*profiling.null_counts(df, ["x"])).collect()[0][0] is None


# 8. integer mean truncates
def test_int_mean_truncates(spark):
    df = spark.createDataFrame([(54,), (55,)], "age int")
    assert profiling.mean_int(df, "age").collect()[0][0] == 54


# 9. mode ties go to the smallest value; even-count median interpolates
def test_mode_tie_and_even_median(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,)], "v int")
    assert tuple(profiling.mode(df, "v").collect()[0]) == (1, 2)
    assert profiling.median(df, "v").collect()[0][0] == 2.0
    q = profiling.five_number(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), "v").collect()[0]
    assert (q["q1"], q["q3"]) == (1.75, 3.25)


# 10. a (gender, band) cell without a known income stays NULL
def test_group_median_leaves_empty_cell_null(spark):
    p = spark.createDataFrame([("a", "F", 20, None), ("b", "F", 22, 100.0), ("c", "M", 80, None)],
                              "id string, gender string, age int, income double")
    out = cleaning.impute_income(p)
    got = {r["id"]: r["income"] for r in out.collect()}
    assert got == {"a": 100.0, "b": 100.0, "c": None}


# 11. a group with no receipts has a NULL rate
def test_zero_receipts_rate_null(spark):
    e = ev(spark, [("p", V, 0, "o1", None, None)])
    r = kpis.view_completion_rate(e).collect()[0]
    assert r["view_rate"] is None and r["completion_rate"] is None


# 13. rupee text in lakh grouping
def test_rupee_text(spark):
    df = spark.createDataFrame([(999.0,), (30000.0,), (120000.0,), (1234567.0,), (None,), (-1500.5,)], "x double")
    got = [r[0] for r in df.select(T.rupee("x")).collect()]
    assert got == ["₹999", "₹30,000", "₹1,20,000", "₹12,34,567", None, "-₹1,501"]
    got2 = [r[0] for r in df.select(T.rupee("x", 2)).collect()]
    assert got2[3] == "₹12,34,567.00" and got2[5] == "-₹1,500.50"


def test_age_and_gender_imputation(spark):
    p = spark.createDataFrame([("a", None, 118), ("b", "M", 54), ("c", "F", 55)], "id string, gender string, age int")
    aged = cleaning.impute_age(p)
    assert {r["id"]: r["age"] for r in aged.collect()}["a"] == 54
    filled = impute.impute_by_draw(aged, "gender").collect()
    assert all(r["gender"] in ("F", "M", "O") for r in filled)


def test_gender_draw_is_deterministic(spark):
    p = spark.createDataFrame([(f"person_{i}", None) for i in range(50)], "id string, gender string")
    a = impute.impute_by_draw(p, "gender").collect()
    b = impute.impute_by_draw(p.repartition(7), "gender").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# 14. empty input for every family
def test_empty_inputs(spark, offers):
    e = ev(spark, [])
    assert quality.completed_after_expiry(e, offers).count() == 0
    assert quality.underspend_window(e, offers).count() == 0
    assert quality.overlapping_receipts(e, offers).count() == 0
    assert cleaning.clean_events(e, offers).count() == 0
    assert kpis.completion_by_viewer_speed(lc.lifecycle(e)).count() == 0
    assert profiling.five_number(e, "amount").collect()[0][0] is None


def test_approximate_quantiles_close_to_exact(tables):
    exact = profiling.five_number(tables.txns, "amount").collect()[0]
    approx = profiling.five_number(tables.txns, "amount", approx=True).collect()[0]
    assert approx[0] == exact[0] and approx[4] == exact[4]
    for e, a in zip(exact, approx):
        assert abs(e - a) <= 0.05 * (exact[4] - exact[0])


def test_orphan_person_keeps_null_person(spark):
    e = ev(spark, [(None, X, 0, None, 1.0, None), ("p", X, 0, None, 2.0, None), ("q", X, 0, None, 3.0, None)])
    prof = spark.createDataFrame([("p",)], "id string")
    got = sorted(((r["person"], r["amount"]) for r in quality.orphan_person(e, prof).collect()), key=repr)
    assert got == sorted([(None, 1.0), ("q", 3.0)], key=repr)
