"""A projection that stays one step of its own in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator, which keeps Catalyst from substituting them into later uses.

    Without it a filter on a derived column is pushed through every projection, costly expressions are
    repeated at each mention, and the generated method outgrows what the JVM can compile.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
