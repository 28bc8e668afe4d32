"""Write PLANS.md: a summary of every registered query's final physical plan.

Usage: python tools/plan_report.py [sf_dir]
Each query is run (collect), then its adaptive plan is inspected for
shuffles, broadcasts, join strategies, windows, top-k and scanned columns.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"gbt_train_score", "cv_grid", "feature_importance", "rf_baseline", "training_summary", "model_risk_summary"}
JOINS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"]


def final_only(plan: str) -> str:
    """Drop every ``== Initial Plan ==`` section (adaptive plans print both)."""
    out, skip_at = [], None
    for line in plan.splitlines():
        m = re.search(r"[A-Za-z*=(]", line)
        col = m.start() if m else 0
        if skip_at is not None:
            if col > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            marker = "+- == Initial Plan ==" if "+- == Initial Plan ==" in line else "== Initial Plan =="
            skip_at = line.index(marker)
            continue
        out.append(line)
    return "\n".join(out)


def summarize(plan: str) -> dict:
    plan = final_only(plan)
    out = {
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|\bExchange RoundRobin", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(f"{j}×{plan.count(j)}" for j in JOINS if plan.count(j)) or "-",
        "windows": plan.count("Window ["),
        "topk": plan.count("TakeOrderedAndProject"),
        "subqueries": len(re.findall(r"[:+]- (?:Reused)?Subquery subquery", plan)),
    }
    scans = re.findall(r"FileScan parquet [^\n]*?Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/(\w+)\.parquet\][^\n]*?ReadSchema: struct<([^>]*)>", plan)
    found = Counter(f"{t}({len(cols.split(','))} cols)" for t, cols in scans)
    out["scans"] = "; ".join(f"{k}×{n}" if n > 1 else k for k, n in sorted(found.items())) or "-"
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from nichelab.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    from nichelab.queries import REGISTRY

    rows = []
    for name, fn in REGISTRY.items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((name, summarize(plan)))
    lines = [
        "# PLANS — final adaptive physical plans of the registered queries",
        "",
        f"Generated by `python tools/plan_report.py` on `local[8]` at `{sf}` (after execution, so joins show",
        "the strategy AQE settled on). Shuffles count hash/range/single-partition exchanges; broadcasts count",
        "broadcast exchanges; scans list each parquet table read, how many columns it reads, and how often (a reused",
        "exchange counts once).",
        "No plan contains a nested-loop join, a Cartesian product or a Python UDF (asserted in tests).",
        "",
        "| Query | Shuffles | Broadcasts | Joins | Windows | Top-k | Subqueries | Scans |",
        "| --- | --- | --- | --- | --- | --- | --- | --- |",
    ]
    for name, s in rows:
        lines.append(
            f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['windows']} | {s['topk']} | {s['subqueries']} | {s['scans']} |"
        )
    lines += [
        "",
        "## Reading notes",
        "",
        "- **Occurrence pipelines** (`occ_*`, `temporal_features`, `ml_ready_*`, `raster_*`, `elevation_lookup`):",
        "  - one `orders` scan reading 2-3 columns;",
        "  - the cell tables are broadcast under the geometry-based size check, so the points are never shuffled;",
        "  - the one shuffle is the per-cell pivot of the raster, independent of the occurrence volume.",
        "- **Metrics** (`standard_metrics`, `roc_*`, `average_precision`, `optimal_threshold`, `model_scores`):",
        "  - a partial + final count per distinct score;",
        "  - the bucket totals and their offsets (broadcast, one row per bucket);",
        "  - windows partitioned by (group, value bucket), never by nothing.",
        "- **`threshold_sweep`** is two small aggregates. There is no 80-way join or row repetition.",
        "- **Grid queries:**",
        "  - the occurrences are pre-aggregated per raster cell before meeting the grid;",
        "  - the two scalar subqueries are the extent (four bounds merged into one aggregate) and the busiest-cell count;",
        "  - `hotspots_top5` is a `TakeOrderedAndProject` of 5 rows, and its window runs on those 5 rows.",
        "- **`holdout_global`'s anti-join on key** is planned as a sort-merge join and turned into a broadcast join by AQE, because",
        "  the local table is small here. At scale it stays a single shuffle of the two key sets.",
    ]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {path} ({len(rows)} queries)")


if __name__ == "__main__":
    main()
