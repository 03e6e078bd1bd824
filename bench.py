"""Benchmark: the two report builds (K1 recon, K2 guard) plus the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line. Report builds write their sheets as parquet below the session's
checkpoint folder; single queries run to completion through the ``noop`` sink (no
driver collect).

``value`` is the median of three combined builds (both reports over one shared detail,
as after every data change). ``k_recon_report`` / ``k_guard_report`` are medians of
three builds of each report alone, the form in which the original application quotes
its build times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shelfcheck.session import build_session

    spark = build_session(f"local[{cpus}]", app_name="shelfcheck-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    from shelfcheck.plans import queries as Q
    from shelfcheck.plans.reports import write_reports
    from shelfcheck.session import scratch_path

    out = scratch_path(spark, "bench", uuid.uuid4().hex)
    times: dict[str, float] = {}
    builds: dict[str, list[float]] = {}
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))

    # The first build of a fresh session (class loading, JIT, code generation, footers) is
    # reported as ``cold``; one more warm-up follows. The timed passes below measure the
    # steady state of a long-running job.
    kinds = ("recon", "guard")
    t0 = time.time()
    write_reports(kinds, Q.recon_inputs(spark, sf_dir), os.path.join(out, "cold"))
    cold = round(time.time() - t0, 3)
    write_reports(kinds, Q.recon_inputs(spark, sf_dir), os.path.join(out, "warm"))

    def median_build(ks: tuple[str, ...], tag: str) -> float:
        runs = []
        for i in range(repeat):
            t0 = time.time()
            write_reports(ks, Q.recon_inputs(spark, sf_dir), os.path.join(out, f"{tag}{i}"))
            runs.append(round(time.time() - t0, 3))
        builds[tag] = runs
        return sorted(runs)[len(runs) // 2]

    total = median_build(kinds, "all")
    for kind in kinds:
        times[f"k_{kind}_report"] = median_build((kind,), kind)

    # Headline queries only: ranks, edits and ingest checks repeat or are small work.
    checks = {"edit_rejects", "edited_table", "edit_misses", "user_flags", "missing_addresses", "scalar_texts",
              "typed_values", "imported_mapping", "pulled_rows", "missing_pages", "load_messages", "one_profile",
              "landed_rows", "published_pull", "stored_pull", "promoted_columns", "merged_types", "current_versions",
              "logged_loads", "loaded_tables", "report_customers", "report_outlets", "payload_sections", "geocode_classes"}
    for name, fn in Q.REGISTRY.items():
        if name.endswith("_rank") or name in checks:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "recon_plus_guard_report_build",
        "value": total,
        "unit": "sec",
        "queries": times,
        "builds": builds,
        "cold": cold,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
