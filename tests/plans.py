"""What a plan is made of."""

import re


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffles_of(df, column):
    """Exchanges that carry a column."""
    nodes = re.findall(r"\(\d+\) (\w+)[^\n]*\nInput[^:]*: \[([^\n]*)\]", formatted(df))
    return sum(name == "Exchange" and re.search(rf"\b{column}#", columns) is not None for name, columns in nodes)
