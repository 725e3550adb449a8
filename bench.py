"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from outfall.queries import QUERIES  # noqa: E402
from outfall.session import get_spark  # noqa: E402

HEADLINE = (
    "ext_03_extract_strings", "mat_01_scan", "mat_14_precision_report", "win_02_recon_claim", "win_01_recon_ranking", "win_03_residue",
    "agg_01_correlate", "agg_02_locations", "agg_04_cluster", "jon_04_suppression", "jon_06_run_diff", "jon_07_previous_run",
    "agg_17_run_summary", "gat_06_gate_verdict", "gat_08_regate", "cmp_05_detect_components", "agg_09_component_inventory",
    "ext_10_extraction_budget", "snk_02_sarif_results", "stm_02_progress_changes", "gat_06_scan_and_gate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                                    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("mat_01_scan", "jon_04_suppression"):  # start-up and compilation are not part of any query
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    texts = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first()["n"]
    texts += spark.read.parquet(f"{folder}/pages.parquet").selectExpr("sum(octet_length(html)) AS n").first()["n"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"), "scanned_mb": round(texts / 1e6, 2),
        "scan_mb_per_sec": round(texts / 1e6 / times["mat_01_scan"], 2),
    }))


if __name__ == "__main__":
    main()
