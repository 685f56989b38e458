"""offerscope: loyalty-offer analytics as lazy Spark DataFrame transformations.

Inputs are three relations: an offer catalogue (``portfolio``), customer
profiles (``profile``) and an event log (``transcript``).  Every public
function takes DataFrames and returns a DataFrame; nothing collects to the
driver, and no Python UDF runs in any plan.

Layout
------
``sources``    readers (JSON lines, tables), sinks, the test-data adapter
``functions``  column expressions: bands, currency text, deterministic draw
``operators``  reusable relational building blocks (lifecycle as-of frame,
               window spend, profiling statistics, imputation)
``plans``      the named analyses (audit, quality rules, cleaning, KPIs,
               exploratory) and their DuckDB oracle SQL
``streaming``  incremental ingest of a growing JSON-lines event log
"""

__all__ = ["session"]
