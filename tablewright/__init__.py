"""Profiling, cleaning, querying and reporting of tabular data on Spark.

Every public function takes DataFrames and returns DataFrames (or Columns), so
the caller keeps Catalyst's view of the whole plan.
"""
