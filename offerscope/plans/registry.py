"""Registry of named analyses: Spark plan + DuckDB oracle SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .context import Tables
from .oracle import with_prelude

ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW_ORACLES: dict[str, str] = {}   # the same queries without the prelude

# Analyses whose rows come in an order: the columns, "-" for descending.  The
# checks compare the rows' order on them, not only the set of rows.
ORDER_BY: dict[str, list[str]] = {
    "aud_gender_counts": ["-gender_count"], "aud_salary_histogram": ["-frequency"],
    "cln_age_mode": ["-cnt"], "cln_age_frequency": ["-age"], "cln_gender_distribution": ["-cnt"], "cln_income_mode": ["-cnt"],
    "dq_underspend_window": ["person", "offer_id", "received_time"], "dq_overlapping_receipts": ["person", "offer_id", "first_received"],
    "kpi_spend_by_income_band": ["average_spend"], "kpi_spend_by_age_band": ["average_spend"], "kpi_spend_by_gender": ["average_spend"],
    "eda_age_mode": ["-cnt"], "eda_age_bands": ["cust_cnt"], "eda_income_mode": ["-cnt"], "eda_income_bands": ["cust_cnt"],
    "eda_joins_yearly": ["Year_"], "eda_joins_monthly": ["Year_", "Month_"], "eda_joins_month_name": ["-cust_cnt"],
    "eda_offer_type_share": ["-offer_distribution"],
    "eda_offers_by_reward": ["-offer_cnt"], "eda_offers_by_difficulty": ["-offer_cnt"], "eda_offers_by_duration": ["-offer_cnt"],
    "eda_event_distribution": ["-cnt"], "eda_txn_per_person": ["-cnt"],
    "eda_received_by_offer": ["-cnt"], "eda_viewed_by_offer": ["-cnt"], "eda_completed_by_offer": ["-cnt"],
}


def ordered_sql(name: str) -> str:
    """The oracle's rows in the analysis' order."""
    by = ", ".join(f'"{c[1:]}" DESC NULLS LAST' if c[0] == "-" else f'"{c}" ASC NULLS FIRST' for c in ORDER_BY[name])
    return f"SELECT * FROM ({ORACLES[name]}) ORDER BY {by}"


def order_values(name: str, columns: list[str], rows: list[tuple]) -> list[tuple]:
    """The rows' values in the columns that they are ordered by."""
    at = [columns.index(c.lstrip("-")) for c in ORDER_BY[name]]
    return [tuple(r[k] for k in at) for r in rows]


def analysis(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` is the
    DuckDB query (without the prelude), or None for a rows-only check."""
    def deco(fn):
        if name in ANALYSES:
            raise ValueError(f"duplicate analysis {name}")
        ANALYSES[name] = fn
        if oracle is not None:
            RAW_ORACLES[name] = oracle
            ORACLES[name] = with_prelude(oracle)
        return fn
    return deco


def money_sum(expr: str) -> str:
    """Exact money sum in the oracle, matching ``operators.spend.money``."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(28,10))) AS DOUBLE)"


def rupee_sql(expr: str, decimals: int = 0) -> str:
    """DuckDB rendering of ``functions.text.rupee`` without look-ahead regex:
    the digits left of the last three are reversed, grouped by two and
    reversed back."""
    dec = f"CAST({expr} AS DECIMAL(38,{decimals}))"
    s = f"CAST(abs({dec}) AS VARCHAR)"
    ip = f"split_part({s}, '.', 1)" if decimals else s
    lakh = (f"CASE WHEN length({ip}) <= 3 THEN {ip} ELSE "
            f"ltrim(reverse(regexp_replace(reverse(substr({ip}, 1, length({ip}) - 3)), '(\\d\\d)', '\\1,', 'g')), ',')"
            f" || ',' || right({ip}, 3) END")
    body = f"{lakh} || '.' || split_part({s}, '.', 2)" if decimals else lakh
    return (f"(CASE WHEN {expr} IS NULL THEN NULL ELSE "
            f"(CASE WHEN {dec} < 0 THEN '-' ELSE '' END) || '₹' || {body} END)")


def load_all() -> None:
    """Import every catalog module so that its analyses register."""
    from . import catalog_audit, catalog_cleaning, catalog_explore, catalog_kpis, catalog_notebook, catalog_quality  # noqa: F401
    from . import catalog_after_cleaning  # noqa: F401
