"""List physical-plan features that do not scale, per driver query.

    python -m checks.plans /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import re
import sys

SUSPECT = {
    "cartesian product": r"CartesianProduct", "nested loop join": r"BroadcastNestedLoopJoin",
    "single partition": r"Exchange SinglePartition", "Python rows": r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups",
}


def suspects(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f"{name} x{len(re.findall(pattern, plan))}" for name, pattern in SUSPECT.items() if re.search(pattern, plan)]


def main() -> None:
    from checks import registry
    from ledgerloom.session import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            # No broadcast: the plan a large table would get.
                                            "spark.sql.autoBroadcastJoinThreshold": "-1"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, make in registry.queries().items():
        if names and name not in names:
            continue
        found = suspects(make(spark, folder))
        if found:
            print(name, "; ".join(found), flush=True)


if __name__ == "__main__":
    main()
