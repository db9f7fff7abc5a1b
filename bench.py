"""Headline timings: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line.  Each query is forced in full with the ``noop``
sink (every column computed, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "redact_documents",            # full pipeline + full-mask splice over all documents
    "redaction_metadata",          # placeholder mode, per-redaction metadata rows
    "context_boost",               # final entity table with boosted confidences
    "entity_distribution_corpus",  # rollup over lang/source/type
    "document_summary",            # per-document counts, no shuffle
    "scrub_forms",                 # all rule kinds on customer forms
    "pseudonymize_document",       # pseudonym mode, per-document numbering
    "pseudonymize_corpus",         # corpus-wide dictionary, skew-safe numbering
    "detect_domain_patterns",      # data-driven patterns from a table
    "audit_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from redactflow.catalog import REGISTRY
    from redactflow.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="redactflow-bench", driver_memory="16g")
    # warm the JVM (regex and codegen paths) on the smallest scale, untimed
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        REGISTRY["redact_documents"][0](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
