"""Summarise every registered query's physical plan into PLANS.md.

For each query: shuffles (hash / range), broadcasts, single-partition
exchanges (global aggregates, or windows over small per-partition or
per-group tables), join strategies, windows, pushed scan filters and any
Python evaluation.  ``python -m quarry.plans.report [sf_dir] > PLANS.md``.
"""

from __future__ import annotations

import re
import sys


def summarise(plan: str) -> dict:
    ex = re.findall(r"Exchange (\w+)", plan)
    return {
        "hash": ex.count("hashpartitioning"),
        "range": ex.count("rangepartitioning"),
        "single": ex.count("SinglePartition"),
        "broadcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "shj": plan.count("ShuffledHashJoin"),
        "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "window": len(re.findall(r"\bWindow \[", plan)),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "python": ("ArrowEvalPython" in plan) or ("FlatMapGroupsInPandas" in plan)
        or ("BatchEvalPython" in plan) or ("MapInPandas" in plan),
        "scan_rdd": plan.count("Scan ExistingRDD"),
    }


def main(argv=None):
    from quarry.plans.registry import load_all
    from quarry.session import get_session
    argv = argv if argv is not None else sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    reg = load_all()
    print("# Physical plans\n")
    print(f"Generated by `python -m quarry.plans.report` on `{sf_dir}` (local[8], AQE on). "
          "Counts are operators in the planned (pre-AQE) physical plan, subqueries included. "
          "`single` = exchanges to one partition: global aggregates (partial per task first), "
          "or windows over tables bounded by partitions, classes, groups or periods; "
          "`rdd` = scans of an existing RDD: a checkpoint written while building the query (global ranks, small "
          "aggregates) or literal rows. Broadcasts are behind a size check or bounded by construction.\n")
    print("| query | check | hash | range | single | bcast | SMJ | BHJ | NLJ | window | pushed | rdd | python |")
    print("|---|---|---|---|---|---|---|---|---|---|---|---|---|")
    for name in sorted(reg, key=lambda n: (reg[n].section[0], int(re.sub(r"\D", "", reg[n].section) or 0), n)):
        q = reg[name]
        try:
            df = q.build(spark, sf_dir)
            s = summarise(df._jdf.queryExecution().executedPlan().toString())
        except Exception as e:  # pragma: no cover - report, don't stop
            print(f"| {name} | {q.check} | error: {type(e).__name__} |")
            continue
        print(f"| {q.section} `{name}` | {q.check} | {s['hash']} | {s['range']} | {s['single']} | "
              f"{s['broadcast']} | {s['smj']} | {s['bhj']} | {s['bnlj']} | {s['window']} | "
              f"{s['pushed']} | {s['scan_rdd']} | {'yes' if s['python'] else ''} |", flush=True)


if __name__ == "__main__":
    main()
