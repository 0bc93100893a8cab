"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "integrated_loudness", "momentary_short_term", "loudness_range", "regional_loudness", "track_stats", "stereo_state_counts", "gate_sensitivity",
    "moving_average", "sliding_min", "slew_limit", "level_steps", "exclusion_merge", "exclusion_weight", "gain_piece_lookup", "true_peak",
    "peak_index_columns", "punch_weights", "dft_bands", "onset_table", "tonal_shape", "qc_errors", "group_summary", "genre_profile", "waterfill_weights",
    "output_report", "side_level_plan",
]


def main() -> None:
    from soundgrid.queries import load
    from soundgrid.session import local_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("OFF")
    registry = load()
    registry["track_stats"].run(spark, root).write.format("noop").mode("overwrite").save()  # start the executors
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        registry[name].run(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": root.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
