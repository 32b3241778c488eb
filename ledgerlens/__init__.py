"""ledgerlens: retail customer analytics as Spark DataFrame operators.

Transactions are cleaned with a one-pass quality report, turned into
recency / frequency / monetary features, scored into quintiles with an
exact distributed rank, mapped to rule segments, clustered with K-Means,
and summarised into dashboard, insight and narrative tables.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark
SQL expressions, so plans stay inside Catalyst and whole-stage codegen.
"""

from ledgerlens.session import get_spark

__all__ = ["get_spark"]
