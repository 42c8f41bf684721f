"""What plans tell after they ran."""

from __future__ import annotations


def scanned(df):
    """Rows that the scans of a frame gave, after it ran."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in name:
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total
