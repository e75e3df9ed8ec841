"""Summarise the executed (final adaptive) plan of registry keys.

``python -m ledgerlens.plans.report /root/testdata/sf0.1 > PLANS.md`` runs
each headline query and lists, from ``explain("formatted")`` of the final
plan: shuffle and broadcast exchanges, join strategies, aggregates, windows,
parquet scans with their ReadSchema, and forbidden nodes (cross products,
Python evaluation). Tables that an operator writes while it is being built are
counted as well, from their plans before execution; reads of such tables are
listed apart.
"""

from __future__ import annotations

import re
import sys

from .inspect import FORBIDDEN, explain, written_plans


def summarize(build) -> dict:
    with written_plans([]) as plans:
        df = build()
    df.write.format("noop").mode("overwrite").save()
    plan = "\n".join([*plans, explain(df, "formatted")])
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+)", plan, flags=re.M)
    count = lambda name: sum(1 for n in nodes if n == name)
    return {
        "shuffles": count("Exchange"),
        "reused_shuffles": count("ReusedExchange"),
        "broadcasts": count("BroadcastExchange"),
        "sort_merge_joins": count("SortMergeJoin"),
        "broadcast_hash_joins": count("BroadcastHashJoin"),
        "shuffled_hash_joins": count("ShuffledHashJoin"),
        "hash_aggregates": count("HashAggregate") + count("ObjectHashAggregate"),
        "windows": count("Window"),
        "parquet_scans": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan))),
        "written_tables": len(plans),
        "forbidden": [n for n in FORBIDDEN if n in plan],
    }


def main() -> None:
    sys.path.insert(0, ".")
    from ..registry import QUERIES
    from ..session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2].split(",") if len(sys.argv) > 2 else [
        "activation_curve", "checkout_funnel", "cohort_retention", "product_engagement", "cart_abandonment",
        "mrr_movements", "trial_conversion", "revenue_retention", "feature_adoption", "expansion_revenue",
        "active_paying_accounts", "plan_breakdown", "first_events",
    ]
    spark = local_session()
    print(f"# Final plans at {sf}\n")
    print("Generated by `python -m ledgerlens.plans.report`. Counts are physical operators of the final")
    print("adaptive plan and of the plans of tables written on the way (AQE may turn sort-merge joins into broadcast joins).\n")
    print("| key | shuffles | reused | broadcasts | SMJ | BHJ | aggregates | windows | written tables | forbidden |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    details = []
    for k in keys:
        s = summarize(lambda key=k: QUERIES[key](spark, sf))
        print(
            f"| {k} | {s['shuffles']} | {s['reused_shuffles']} | {s['broadcasts']} | {s['sort_merge_joins']} | "
            f"{s['broadcast_hash_joins']} | {s['hash_aggregates']} | {s['windows']} | {s['written_tables']} | {', '.join(s['forbidden']) or '-'} |"
        )
        details.append((k, s["parquet_scans"]))
    print("\n## Parquet read schemas (column pruning)\n")
    for k, scans in details:
        print(f"* `{k}`: " + ("; ".join(f"`{x}`" for x in scans) if scans else "none"))


if __name__ == "__main__":
    main()
