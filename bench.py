"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)

Each query is planned and run to the end against a sink that discards rows, so
neither collection nor rendering is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans import catalog
from tickloom.session import local_session

HEADLINE = [
    "w1_dedupe_keep_first", "w1_deduped_vwap", "a1_tick_state", "a2_deal_state", "a3_order_state", "a4_full_state",
    "a5_bars_cumulative", "a12_multi_slice_state", "ud9_factor_pack", "a6_index_weights", "j3_membership_in_time",
    "j5_asof_free_shares", "j12_history_attach", "p3_merged_split", "p6_tick_normalise", "p15_archive_encode",
    "p16_archive_decode", "p17_clock_repair", "w2_momentum", "w4_tail_weights", "u3_row_backfill", "u4_column_backfill",
    "o1_positions_to_orders", "a13_active_exposures", "q8_snapshot_selection", "q3_archive_check", "a18_factor_diff",
    "r3_store_diff", "a21_sequence_stats", "s16_archive_sink", "ud1_fold_factors", "ud8_linear_score", "st2_stream_state", "ud1_frame_factors", "ud2_batch_factors",
    "f3_special_treatment", "ud11_inference_inputs", "st10_round_factors",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="tickloom-bench")
    queries = catalog.queries()
    # First use of a session pays for class loading; keep it out of the first query.
    queries["a10_duplicate_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
