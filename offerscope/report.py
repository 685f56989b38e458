"""Run registered analyses over one set of inputs and write each result.

    python -m offerscope.report --sf-dir /root/testdata/sf0.01 --out /tmp/report [name ...]

The shared intermediates (flattened log, de-duplicated log, cleaned profile)
are materialized once; each analysis is then one Spark job writing parquet
to ``<out>/<name>``.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .plans import ANALYSES, Tables, load_all


def run_report(tables: Tables, out_dir: str, names: list[str] | None = None,
               materialize_inputs: bool = True, mode: str = "overwrite") -> dict[str, float]:
    """Write every requested analysis to ``out_dir/<name>``; returns seconds per analysis."""
    load_all()
    t = tables.materialized() if materialize_inputs else tables
    timings = {}
    for name in names or sorted(ANALYSES):
        start = time.perf_counter()
        ANALYSES[name](t).write.mode(mode).parquet(f"{out_dir.rstrip('/')}/{name}")
        timings[name] = round(time.perf_counter() - start, 3)
    return timings


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--sf-dir", required=True, help="folder with events.parquet and customer.parquet")
    ap.add_argument("--out", required=True, help="output folder (one parquet folder per analysis)")
    ap.add_argument("names", nargs="*", help="analyses to run (default: all)")
    args = ap.parse_args(argv)
    from .session import local_session
    spark = SparkSession.getActiveSession() or local_session()
    timings = run_report(Tables.from_testdata(spark, args.sf_dir), args.out, args.names or None)
    for name, sec in timings.items():
        print(f"{name}\t{sec}")


if __name__ == "__main__":
    main()
