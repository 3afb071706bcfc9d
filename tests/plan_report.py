"""Summarise the executed (final AQE) physical plans of the headline queries.

Usage: python tests/plan_report.py [sf_dir]  -> markdown on stdout.
Parses ``explain("formatted")`` of the executed query: every operator is
counted once (by its id) across the main plan and all subquery plans, only
from final-plan sections.  Operators inside cached relations (the proxy
aggregates, built once per session) are reported separately.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regiopanel.plans import registry as R  # noqa: E402
from regiopanel.session import get_session  # noqa: E402

QUERIES = ["indicators", "recompute_with_forecast", "forecast_trend", "region_overview", "kpis",
           "scenario_eval", "import_summary", "import_errors", "region_rank"]
NODE = re.compile(r"([A-Za-z][A-Za-z ]*?) \((\d+)\)")
KINDS = [("shuffle Exchange", lambda n: n == "Exchange"), ("BroadcastExchange", lambda n: n == "BroadcastExchange"),
         ("SortMergeJoin", lambda n: n.startswith("SortMergeJoin")),
         ("BroadcastHashJoin", lambda n: n.startswith("BroadcastHashJoin")),
         ("BroadcastNestedLoopJoin", lambda n: n.startswith("BroadcastNestedLoopJoin")),
         ("Window", lambda n: n == "Window"), ("HashAggregate", lambda n: n.endswith("HashAggregate")),
         ("Scan parquet", lambda n: n.startswith("Scan parquet")),
         ("InMemoryTableScan", lambda n: n == "InMemoryTableScan")]


def formatted(df) -> str:
    df.collect()
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def final_nodes(text: str) -> tuple[dict, dict, int]:
    """(top-level nodes, cached-relation nodes, number of subqueries)."""
    top, cached = {}, {}
    skip = cache = None
    for line in text.splitlines():
        if re.match(r"^\(\d+\) ", line) or not line.strip():
            skip = cache = None
            continue
        body = line.lstrip(" :+-")
        indent = len(line) - len(body)
        if skip is not None and indent >= skip:
            continue
        skip = None
        if cache is not None and indent <= cache:
            cache = None
        if body.startswith("== Initial Plan =="):
            skip = indent
            continue
        m = NODE.match(body[2:] if body.startswith("* ") else body)
        if not m:
            continue
        name, nid = m.group(1).strip(), int(m.group(2))
        (cached if cache is not None else top)[nid] = name
        if name == "InMemoryRelation" and cache is None:
            cache = indent
    top = {k: v for k, v in top.items() if k not in cached}
    return top, cached, len(re.findall(r"^Subquery:\d+", text, re.M))


def counts(nodes: dict) -> Counter:
    c = Counter()
    for name in nodes.values():
        for kind, pred in KINDS:
            if pred(name):
                c[kind] += 1
    return c


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Plan report\n\nExecuted AQE final plans at `{sf}`, local[8], 8 shuffle partitions. Each operator "
          "is counted once across the main plan and its scalar subqueries. Operators inside cached relations (the two proxy "
          "aggregates and per-run forecast statistics) are listed separately; they run once per session.\n")
    kinds = [k for k, _ in KINDS]
    print("| query | subqueries | " + " | ".join(kinds) + " |")
    print("|---" * (len(kinds) + 2) + "|")
    cached_all = {}
    for q in QUERIES:
        top, cached, n_sub = final_nodes(formatted(R.QUERIES[q](spark, sf)))
        cached_all.update(cached)
        c = counts(top)
        print(f"| {q} | {n_sub} | " + " | ".join(str(c.get(k, 0)) for k in kinds) + " |")
    c = counts(cached_all)
    print("\nCached relations (proxy aggregates, forecast statistics), together: " + ", ".join(f"{k} {c.get(k, 0)}" for k in kinds) + ".")


if __name__ == "__main__":
    main()
