"""Look at the physical plan of every job a question starts: no all-pairs joins, no unpartitioned windows over pixels.

usage: python tests/plan_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def findings(plan: str) -> list[str]:
    found = [word for word in FORBIDDEN if word in plan]
    for line in plan.splitlines():
        if re.search(r"Exchange SinglePartition", line) and "ENSURE_REQUIREMENTS" in line:
            found.append("SinglePartition")
    return found


def watch(report):
    """Inspect each DataFrame that is checkpointed or collected while a question is built."""
    from pyspark.sql.classic.dataframe import DataFrame

    for name in ("checkpoint", "collect", "toPandas"):
        original = getattr(DataFrame, name)

        def spy(self, *args, _original=original, **kwargs):
            report(self)
            return _original(self, *args, **kwargs)

        setattr(DataFrame, name, spy)


def main() -> int:
    from ionloom.plans import catalog
    from ionloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    seen: list[str] = []

    def report(df):
        seen.extend(findings(df._jdf.queryExecution().executedPlan().toString()))

    watch(report)
    bad = 0
    for name in names:
        seen.clear()
        report(catalog.QUERIES[name](spark, sf_dir))
        counts = {w: seen.count(w) for w in sorted(set(seen))}
        bad += any(w in counts for w in FORBIDDEN)
        if counts:
            print(name, counts, flush=True)
    print(f"{len(names)} questions, {bad} with all-pairs joins")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
