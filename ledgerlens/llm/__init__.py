"""Operators of a training-data pipeline on Spark.

Nothing outside this package imports it: ``__spark_entry__.py`` adds its
queries only when the package is there.
"""
