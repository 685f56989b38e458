"""Every registered analysis against its DuckDB oracle on the smallest fixture."""

import math

import pytest

import __spark_entry__ as entry
from offerscope.plans import ANALYSES, ORACLES
from offerscope.plans.registry import ORDER_BY, order_values, ordered_sql

# The library's own analyses; optional queries have tests beside them.
QUERIES = {name: f for name, f in entry.queries().items() if name in ANALYSES}


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if not math.isnan(v) else "nan"
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert _canon(df.columns, got) == _canon(rel.columns, want)
    if name in ORDER_BY:
        in_order = duck.sql(ordered_sql(name))
        norm = [[_norm(v) for v in r] for r in order_values(name, df.columns, got)]
        assert norm == [[_norm(v) for v in r] for r in order_values(name, in_order.columns, in_order.fetchall())]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    from conftest import SF_SMALL
    df = QUERIES[name](spark, SF_SMALL)
    n = df.count()
    assert n == (100 if name == "nb_sample_events" else 5)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    out = df.collect()
    assert set(df.columns) == {"offer_type", "view_rate", "completion_rate"}
    assert len(out) == 2


def test_every_query_has_oracle_or_is_nondeterministic():
    missing = set(QUERIES) - set(ORACLES)
    assert all(n.startswith("dq_preview_") or n == "nb_sample_events" for n in missing)


def test_every_order_is_of_an_analysis():
    assert set(ORDER_BY) <= set(ORACLES)
