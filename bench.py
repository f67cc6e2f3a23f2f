"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs to completion through a no-op sink (the whole plan
executes, nothing is collected).  Sample-size parameters are those of the
registered queries, except ``two_phase_sample``, which draws the
reference's default 60,000 rows here.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitcraft.session import get_session  # noqa: E402

HEADLINE = ["template_abstract", "uat_cli", "uat_splits", "validate_and_fix", "hierarchical_splits",
            "two_phase_sample_60k", "cap_per_template", "template_pairs", "nearest_templates",
            "exact_match", "sequence_accuracy", "bleu", "rouge", "compositional_split", "neighbour_sets"]


def _queries():
    from splitcraft.operators import sampling as SM
    from splitcraft.plans.catalog import QUERIES, training_pool
    qs = {k: fn for k, (fn, _sql) in QUERIES.items()}

    def two_phase_60k(spark, sf_dir):
        pool = training_pool(spark, sf_dir).select("example_id", "abstract_template")
        return SM.two_phase_sample(pool, "example_id", "abstract_template", 60000, 0.0).select("example_id")
    qs["two_phase_sample_60k"] = two_phase_60k
    return qs


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = _queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
