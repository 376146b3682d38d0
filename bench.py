"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks import QUERIES
from stillwave.session import build_session

HEADLINE = (
    "t1_hecht_nonwear", "t2_troiano_nonwear", "t3_choi_nonwear", "t4_hees_nonwear_samples", "a3_many_epoch_lengths",
    "a4_block_std_and_range", "e1_vector_to_episodes", "e2_episodes_to_vector", "e3_group_near_episodes",
    "f6_j4_samples_in_episodes", "t5_t6_candidate_segments_grown", "x1_x2_x5_segment_features",
    "v3_v4_method_totals", "g2_g3_hecht_grid", "g2_g3_troiano_grid", "g2_g3_choi_grid", "g2_g3_hees_grid", "j3_full_outer_timeline",
    "g4_held_out_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and code generation are not part of a query.
    QUERIES["a4_block_std_and_range"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
