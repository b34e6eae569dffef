"""What an executed plan did."""


def rows_met(df):
    """Runs df and gives the greatest number of rows that a join of it puts out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        at = plan.pop()
        kind = at.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(at.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(at.plan())
        if "Join" in kind and at.metrics().contains("numOutputRows"):
            most = max(most, at.metrics().apply("numOutputRows").value())
        plan += [at.children().apply(k) for k in range(at.children().size())]
    return most
