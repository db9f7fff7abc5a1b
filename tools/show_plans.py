"""Print the physical plan summary of the headline queries: exchanges, scans
(read schema), broadcasts and codegen stages.  Usage: python tools/show_plans.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from redactflow.catalog import REGISTRY  # noqa: E402
from redactflow.session import local_session  # noqa: E402


def summary(plan: str) -> list[str]:
    keep = []
    for line in plan.splitlines():
        s = line.strip()
        if re.search(r"Exchange|Scan parquet|BroadcastHashJoin|SortMergeJoin|HashAggregate|Window |Generate|"
                     r"ReadSchema|PushedFilters|WholeStageCodegen|AQEShuffleRead", s):
            keep.append(line[:160])
    return keep


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    for name in HEADLINE:
        df = REGISTRY[name][0](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}")
        print("\n".join(summary(plan)))
        print()


if __name__ == "__main__":
    main()
