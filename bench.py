"""Headline workloads; prints one JSON line with seconds per query.

``BENCH_SF_DIR`` selects the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the sizes of
the parameter sweeps.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from tidebar import plans  # noqa: E402
from tidebar.operators import portfolio  # noqa: E402
from tidebar.operators.signals import Costs, Run  # noqa: E402
from tidebar.plans import fixtures as fx  # noqa: E402
from tidebar.session import durable, local_session  # noqa: E402

HEADLINES = [
    "hourly_bars",
    "quarter_hour_bars",
    "brand_day_bars",
    "dense_day_grid",
    "day_returns",
    "moving_averages",
    "zscores",
    "brand_statistics",
    "benchmark_statistics",
    "coverage_gaps",
    "ledger_of_journal_fills",
    "journal_summary",
    "order_verdicts",
]


def sweep_runs(n: int) -> list[Run]:
    """Trend and reversion runs with different windows, levels and costs."""
    runs = []
    for i in range(n):
        costs = Costs(slippage_bps=1 + i % 7, commission_bps=i % 3)
        if i % 2:
            fast = 2 + i // 2 % 5
            params = {"fast": fast, "slow": fast + 2 + i // 10 % 6, "long_short": i % 4 == 1}
            runs.append(Run(f"r{i}", "sma_cross", params, costs))
        else:
            params = {
                "lookback": 3 + i // 2 % 5,
                "entry_z": 0.6 + 0.1 * (i // 10 % 4),
                "max_positions": 30,
            }
            runs.append(Run(f"r{i}", "mean_reversion", params, costs))
    return runs


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidebar-bench")
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    drain(plans.QUERIES["hourly_bars"](spark, sf_dir))  # starts the JVM and its compiler
    seconds = {
        name: timed(lambda name=name: drain(plans.QUERIES[name](spark, sf_dir)))
        for name in HEADLINES
    }
    bars = durable(fx.calm(fx.brand_days(spark, sf_dir)))
    for n in map(int, os.environ.get("BENCH_RUNS", "100").split(",")):
        made: list[portfolio.Sweep] = []
        seconds[f"sweep_{n}_runs"] = timed(
            lambda n=n: made.append(portfolio.run_sweep(bars, sweep_runs(n), "1Day"))
        )
        seconds[f"statistics_{n}_runs"] = timed(lambda: drain(made[0].stats()))
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
