"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from diffspark.session import local_session
from registry import QUERIES

HEADLINES = (
    "lodo_report",
    "session_split",
    "eval_report",
    "metrics_large_two_level",
    "auc_ties",
    "best_f1_by_group",
    "pr_curve",
    "confusion_at_threshold",
    "early_stop",
    "early_stop_min_delta",
    "exact_two_way_split",
    "session_table",
    "label_strict_join",
    "key_audit",
    "split_list_lines",
    "geometry_text_panels",
    "gcn_frames",
    "normalize_arrow",
    "lcn_window_sweep",
    "routed_preprocess",
    "panel_assemble",
    "display_range",
    "logit_scores",
    "batch_model_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app_name="diffspark-bench")
    seconds: dict[str, float] = {}
    with contextlib.redirect_stdout(sys.stderr):
        # One pass over a small query starts the JVM's and the workers' machinery.
        QUERIES["session_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        for name in HEADLINES:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(f"{name:28s} {seconds[name]:7.3f}", flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
