"""Markdown table of the headline queries: this package beside the checking engine."""

from __future__ import annotations

import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import bench  # noqa: E402
import check_oracle  # noqa: E402
from tallyforge.session import build_session  # noqa: E402


def engine_time(con, sql: str, runs: int) -> float:
    def once() -> float:
        start = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql}")
        return time.perf_counter() - start

    once()
    return statistics.median(once() for _ in range(runs))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("baseline", "local[8]", 8, {"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = check_oracle.connect(sf_dir)
    print("| Query | Spark median s | DuckDB median s | Rows out |")
    print("|---|---|---|---|")
    for name in bench.HEADLINE:
        bench.timed(name, spark, sf_dir)
        ours = statistics.median(bench.timed(name, spark, sf_dir) for _ in range(3))
        theirs = engine_time(con, check_oracle.ORACLE[name], 3)
        rows = con.execute("SELECT count(*) FROM result").fetchone()[0]
        print(f"| {name} | {ours:.2f} | {theirs:.2f} | {rows} |", flush=True)


if __name__ == "__main__":
    main()
