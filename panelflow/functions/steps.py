"""Chains of named expressions that Spark and other SQL engines read alike.

A chain is a list of dictionaries from column name to expression; the expressions of one may use
the columns of those before it. Doubles are written ``1.0E0``, and ``round_even`` rounds halves to
the even number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[dict[str, str]]


def spark_text(expression: str) -> str:
    return expression.replace("round_even(", "bround(")


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    for step in steps:
        df = df.withColumns({n: F.expr(spark_text(e)) for n, e in step.items()})
    return df


def nested(source: str, steps: Steps) -> str:
    """The chain as a query over ``source``, a table name or a query in brackets."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    return source
