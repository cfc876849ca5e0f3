"""Headline benchmark: prints one JSON line with seconds per query."""

import json
import os
import signal
import sys
import time

from hotgrid import plans, session

HEADLINE = (
    "enriched_incidents", "active_cells", "cell_profile", "gi_star", "gi_star_layers", "gi_star_local", "kde_surface",
    "region_summary", "period_counts", "type_breakdown", "region_trends", "rolling_anomaly", "seasonal_anomaly",
    "anomaly_feed", "changepoints", "emerging_cells", "near_repeat", "feature_matrix", "risk_map", "pai", "ranking_metrics",
    "cooccurrence_edges", "degree_centrality", "components", "repeat_entities", "corridors", "greedy_coverage",
    "coverage_summary", "briefings", "region_disparity", "reporting_bias", "alert_feed", "sprees",
    "gi_star_permutation", "local_moran_p", "entity_profiles", "community_report", "removal_analysis", "articulation_points", "eigenvector",
    "risk_model_metrics", "calibration_report", "communities",
)
BUDGET_SEC = float(os.environ.get("BENCH_BUDGET_SEC", "1200"))


class Overdue(BaseException):
    """The budget ran out in the middle of a query."""


def overdue(*_) -> None:
    raise Overdue


def main() -> None:
    signal.signal(signal.SIGALRM, overdue)
    signal.signal(signal.SIGTERM, overdue)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = plans.queries()
    names = sys.argv[1:] or HEADLINE
    # load classes and code paths once so that the first query is not charged for them
    queries["active_cells"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    signal.setitimer(signal.ITIMER_REAL, BUDGET_SEC)
    try:
        for name in names:
            t0 = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    except Overdue:
        print(f"time budget reached in {name}", file=sys.stderr)
    signal.setitimer(signal.ITIMER_REAL, 0)
    line = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(line), flush=True)
    os._exit(0)  # a query that was cut short may still hold the session


if __name__ == "__main__":
    main()
