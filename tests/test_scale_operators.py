"""Operators that must hold for any one person, offer or value range: rank
selection, two-level windows, sliced range joins, the delete chain as one plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offerscope import schemas
from offerscope.functions import fixed
from offerscope.operators import lifecycle as lc
from offerscope.operators import prepare, profiling, selection
from offerscope.operators.sliced import SLICE, Running, deal, running
from offerscope.operators.spend import spends, txn_points
from offerscope.plans import ANALYSES, cleaning, load_all, quality

load_all()
R, V, X, C = fixed.OFFER_RECEIVED, fixed.OFFER_VIEWED, fixed.TRANSACTION, fixed.OFFER_COMPLETED


def jobs_while(spark, build):
    """Spark jobs that run while ``build()`` is called."""
    group = f"build-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = build()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- rank selection

RND = random.Random(7)
DATA = {
    "none": [], "nulls": [None, None], "one": [4.25], "pair": [1.0, 2.0], "ties": [3.0] * 50 + [-1.0],
    "signs": [-5.5, 0.0, -0.0, 3.0, 3.0, 7.25, None], "normal": [RND.gauss(0, 1e5) for _ in range(2000)],
    "money": [round(RND.random() * 100, 2) for _ in range(3000)], "neighbours": [1 + k * 2.0 ** -52 for k in range(700)],
    "sizes": [RND.choice([1e-300, 1e300, -1e-300, 0.0, 5e-324, -2.5]) * RND.random() for _ in range(1500)],
}
PROBS = [0.0, 0.25, 0.5, 0.75, 1.0, 0.123, 0.999]


@pytest.mark.parametrize("name", sorted(DATA))
def test_selection_equals_percentile(spark, name):
    df = spark.createDataFrame([(v,) for v in DATA[name]], "v double")
    names = [f"q{k}" for k in range(len(PROBS))]
    got = selection.select_quantiles(df, "v", PROBS, names).collect()
    assert [tuple(r) for r in got] == [tuple(profiling.quantiles(df, "v", PROBS, names).first())]


def test_selection_of_infinities(spark):
    df = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 2.0, math.inf, math.inf)], "v double")
    assert tuple(selection.select_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], list("abcd")).first()) == (-math.inf, 1.0, 2.0, math.inf)


def test_last_bracket_is_bounded(spark):
    """200,000 different values: the last step reads next to none of them."""
    df = spark.range(200_000).select((F.exp(F.randn(3) * 4)).alias("v"))
    values = selection.counted_values(df, "v")
    last = selection.narrow(values, [0.25, 0.5, 0.75])
    sizes = [r["count"] for r in selection.within(values, last).groupBy("_b").count().collect()]
    assert sizes and max(sizes) <= 4
    assert values.count() > 190_000


def test_selection_is_one_plan(spark, tables):
    df, jobs = jobs_while(spark, lambda: ANALYSES["eda_amount_five_number"](tables))
    assert jobs == 0
    assert "ReusedExchange" in executed(df) or "ReusedQueryStage" in executed(df) or executed(df).count("FileScan") <= 4


# ---------------------------------------------------------------- two-level windows

def hot_log(spark, hours=6000):
    """One person with half of all rows, spread over many hours; a hundred others."""
    def event(k):
        return F.when(k % 4 == 0, R).when(k % 4 == 1, V).when(k % 4 == 2, C).otherwise(X)
    k = F.col("id")
    hot = spark.range(hours).select(F.lit("hot").alias("person"), event(k).alias("event"), k.cast("int").alias("time"))
    rest = spark.range(hours).select(F.concat(F.lit("p"), (k % 100).cast("string")).alias("person"), event(F.floor(k / 100)).alias("event"), (k % 2400).cast("int").alias("time"))
    log = hot.unionByName(rest)
    bought = F.col("event") == X
    return log.select("person", "event", "time", F.when(~bought, F.lit("o1")).alias("offer_id"),
                      F.when(bought, F.lit(2.5)).alias("amount"), F.when(F.col("event") == C, F.lit(5.0)).alias("reward"))


def share_of_hot_in_one_task(frame, person="person"):
    rows = frame.filter(F.col(person) == "hot").groupBy(F.spark_partition_id().alias("t")).count().collect()
    return max(r["count"] for r in rows) / sum(r["count"] for r in rows), len(rows)


@pytest.fixture(scope="module")
def many_tasks(spark):
    """Enough tasks to be dealt over, and none of them joined up again."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_person_lifecycle_is_spread(many_tasks):
    frame = lc.lifecycle(hot_log(many_tasks))
    share, tasks = share_of_hot_in_one_task(frame)
    assert tasks >= 8 and share <= 0.3


def test_hot_person_spend_is_spread(many_tasks):
    points = txn_points(hot_log(many_tasks).filter(F.col("event") == X))
    swept = running(deal(points, ["_p"], "_t"), ["_t", "_kind"], [Running("sum", "sum", F.col("_n"))])
    share, tasks = share_of_hot_in_one_task(swept, "_p")
    assert tasks >= 8 and share <= 0.3
    assert swept.filter("_p = 'hot'").agg(F.max("sum")).first()[0] == 1500


@pytest.mark.parametrize("width", [1, 7, 240, 1e9])
def test_slices_do_not_change_the_frame(spark, tables, width):
    keys = lc.event_keys(tables.flat)
    narrow, whole = lc.lifecycle_from_keys(keys, width), lc.lifecycle_from_keys(keys, 1e9)
    assert narrow.exceptAll(whole).count() == 0 and whole.exceptAll(narrow).count() == 0


def test_running_against_python(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), t, rnd.choice([None, 1, 2, 5, -3])) for t in rnd.sample(range(-50, 400), 120)]
    df = spark.createDataFrame([(None, 1, 4), *rows], "k string, t int, v int")
    asked = [Running(f"{how}_{side}", how, F.col("v"), side) for how in ("sum", "max", "min") for side in ("upto", "before", "from", "after")]
    got = {(r["k"], r["t"]): r for r in running(deal(df, ["k"], "t", 30), ["t"], asked).collect()}
    for k, t, _ in rows:
        for r in asked:
            inside = {"upto": lambda u: u <= t, "before": lambda u: u < t, "from": lambda u: u >= t, "after": lambda u: u > t}[r.side]
            seen = [v for j, u, v in rows if j == k and inside(u) and v is not None]
            want = {"sum": sum, "max": max, "min": min}[r.how](seen) if seen else None
            assert got[k, t][r.name] == want, (k, t, r.name)
    assert got[None, 1]["sum_upto"] == 4 and got[None, 1]["sum_after"] is None


@pytest.mark.parametrize("width", [1, 5, 240])
def test_spends_of_several_ends(spark, width):
    rnd = random.Random(5)
    txns = [(rnd.choice("ab"), X, rnd.randrange(60), None, rnd.choice([0.1, 2.25, -1.5, 3.0000000001]), None) for _ in range(80)]
    spans = sorted({(rnd.choice("abz"), rnd.randrange(60), rnd.randrange(60), rnd.randrange(80)) for _ in range(40)})
    points = txn_points(spark.createDataFrame(txns, schemas.EVENTS))
    frame = spark.createDataFrame(spans, "person string, a int, b int, c int")
    for r in spends(frame, points, "a", ["b", "c"], slice_hours=width).collect():
        for k, end in ((0, r["b"]), (1, r["c"])):
            inside = [x[4] for x in txns if x[0] == r["person"] and r["a"] <= x[2] <= end]
            assert r[f"n_txn_{k}"] == len(inside)
            assert (r[f"spend_{k}"] is None) == (not inside)
            if inside:
                assert float(r[f"spend_{k}"]) == pytest.approx(sum(inside), abs=1e-9)


# ---------------------------------------------------------------- sliced range joins

@pytest.mark.parametrize("width", [1, 6, 240])
def test_unviewed_pairs_against_python(spark, width):
    rnd = random.Random(11)
    rows = [(rnd.choice(["p", "q", None]), rnd.choice([R, R, C, C, V]) if rnd.random() < 0.9 else V, rnd.randrange(40), rnd.choice(["o1", "o2"]), None, rnd.choice([None, 5.0, 9.0]))
            for _ in range(60)]
    rows = [r for r in rows if r[1] != V or r[2] > 30]
    e = spark.createDataFrame(rows, schemas.EVENTS).distinct()
    seen = [tuple(r) for r in e.collect()]
    want = sorted((c[0], c[3], r[2], c[2]) for c in seen if c[1] == C and c[0] is not None
                  and not any(v[1] == V and v[0] == c[0] and v[3] == c[3] and v[2] <= c[2] for v in seen)
                  for r in seen if r[1] == R and r[0] == c[0] and r[3] == c[3] and r[2] <= c[2])
    assert sorted(tuple(r) for r in quality.completed_unviewed_pairs(e, slice_hours=width).collect()) == want


def log_scans(plan):
    """Times that the executed plan parses the log."""
    return plan.split("== Initial Plan ==")[0].count("json_tuple(")


@pytest.mark.parametrize("name", ["dq_completed_unviewed", "dq_overlapping_receipts", "dq_overlapping_receipts_alt", "dq_completed_after_expiry",
                                  "kpi_completion_by_viewer_speed", "cln_drop_superseded_receipts"])
def test_log_is_read_once(spark, tables, name):
    """One key frame, for both roles of a receipt and for the slices' totals."""
    assert log_scans(executed(ANALYSES[name](tables))) == 1


@pytest.mark.parametrize("name", ["dq_underspend_max", "dq_underspend_window", "cln_drop_underspend_lateral"])
def test_spend_rules_read_the_log_twice(spark, tables, name):
    """Once for the key frame, once for the purchases."""
    assert log_scans(executed(ANALYSES[name](tables))) <= 2


# ---------------------------------------------------------------- delete chain

def test_chain_is_one_plan(spark, tables):
    df, jobs = jobs_while(spark, lambda: ANALYSES["cln_final_events"](tables))
    assert jobs == 0
    assert log_scans(executed(df)) <= 2


@pytest.mark.parametrize("width", [1, 24, 1e9])
def test_chain_equals_rules_one_after_another(spark, width):
    """The one-pass chain against the rules run in order on the rows that each leaves."""
    rnd = random.Random(width)
    made = [(rnd.choice("pqr"), rnd.choice([R, R, C, C, V]), rnd.randrange(0, 90), rnd.choice(["o1", "o2", "gone"]), None, rnd.choice([None, 5.0])) for _ in range(160)]
    made += [(rnd.choice("pqr"), X, rnd.randrange(0, 90), None, rnd.choice([0.4, 3.0, 9.6]), None) for _ in range(30)]
    log = spark.createDataFrame(made, schemas.EVENTS).distinct()
    first, offers = log, prepare.onehot_channels(spark.createDataFrame(
        [("o1", 5, 10, 1.0, "bogo", ["web"]), ("o2", 2, 4, 0.5, "discount", ["web"])], schemas.PORTFOLIO))
    for steps, (rule, event, time) in enumerate([(cleaning.superseded_receipts, R, "first_received"), (cleaning.underspend_window_flagged, C, "completed_time"),
                                                 (cleaning.underspend_completion_flagged, C, "completed_time"), (cleaning.underspend_lateral_flagged, C, "completed_time")], 1):
        hit = {tuple(r) for r in rule(log, offers).select("person", "offer_id", time).collect()}
        left = [tuple(r) for r in log.collect() if not (r["event"] == event and (r["person"], r["offer_id"], r["time"]) in hit)]
        log = spark.createDataFrame(left, schemas.EVENTS)
        got = sorted(map(repr, map(tuple, cleaning.clean_events(first, offers, steps, slice_hours=width).collect())))
        assert got == sorted(map(repr, left)) and hit


def test_slice_column_does_not_show(tables):
    assert SLICE not in tables.lifecycle.columns
