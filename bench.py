"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from corvane.plans.registry import QUERIES
from corvane.session import local_session

HEADLINE = [
    "d10_funnel_counts", "d1_exact_dedup", "j1_anti_join_attributed", "p1_norm_key_nfkc", "p10_split_by_heading",
    "p21_char_ngrams", "p22_jaccard", "v3_nearest", "j7_max_sim_per_label", "d4_near_dup_cosine", "t2_per_label_split",
    "l10_agreement_by", "c2_threshold_sweep", "c5_locked_rule", "c1_fit_temperature", "x2_replay_cascade", "e7_auc",
    "e9_latency_percentiles", "e10_bootstrap_mean_ci", "e1_classification_summary", "r1_bm25", "r3_fuse_max_select",
    "st5_windowed_decision_metrics",
]

# Timed after the headline and not summed into it, the slow ones last; none is started after ALSO_SECONDS.
ALSO = ["r6_rerank_by_score_table", "r12_multi_config_compare", "c13_fusion_weight_grid", "d5_near_dup_ngram",
        "e11_bootstrap_metric_ci", "d6_near_dup_report", "m11_fit_grid"]
ALSO_SECONDS = 240


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(os.environ.get("BENCH_PARTITIONS", "8")), app="bench")
    spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").count().collect()  # start the engine
    began = time.time()

    def timed(name):
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - t0, 3)

    times = {name: timed(name) for name in HEADLINE}
    also = {name: timed(name) for name in ALSO if time.time() - began < ALSO_SECONDS}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "also": also, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
