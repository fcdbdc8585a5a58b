"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from slopeline import plans
from slopeline.session import local

HEADLINE = [
    "exceedance_fusion", "trailing_rain_features", "hourly_exceedance", "safe_window", "runout_triangles", "road_risk", "nearest_site", "eps_priority", "report_dedup", "report_hotspot",
    "holdout_exclude", "shortest_paths", "cascade_3hop", "choke_points", "calibration", "auc_rank", "escalation_transitions", "audit_chain", "keyword_classify", "telemetry_rollup", "stream_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(int(os.environ.get("BENCH_CPUS", "8")), **{"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
