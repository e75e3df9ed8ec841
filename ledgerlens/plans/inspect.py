"""Plan inspection through the public ``explain`` API.

Used by the plan tests (no cross products, no Python evaluation, pruned
scans) and handy when tuning an operator: ``print(explain(df))``.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def physical_plan(df: DataFrame) -> str:
    text = explain(df, "extended")
    return text.split("== Physical Plan ==", 1)[-1]


def forbidden_nodes(plan: DataFrame | str) -> list[str]:
    text = plan if isinstance(plan, str) else physical_plan(plan)
    return [name for name in FORBIDDEN if name in text]


@contextlib.contextmanager
def written_plans(plans: list[str]):
    """Collects the plans of the tables that operators write while they are being built."""
    from .. import session

    write = session._write

    def noted(df, path):
        plans.append(explain(df, "formatted"))
        write(df, path)

    session._write = noted
    try:
        yield plans
    finally:
        session._write = write


def scan_schemas(plan: DataFrame | str) -> list[str]:
    """ReadSchema of every parquet scan in the plan."""
    text = plan if isinstance(plan, str) else explain(plan, "formatted")
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
