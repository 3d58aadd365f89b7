"""Explanation analytics over tables, written as Spark DataFrame programs.

Every operator takes and returns DataFrames (or Columns), carries explicit
keys (``record_id``, ``group_idx``, ``case_id``, ``run_id``, ``subset_idx``)
and never depends on row order.
"""

__version__ = "0.1.0"
