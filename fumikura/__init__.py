"""Corpus curation on Spark: mine titles, filter by word lists, judge, verify.

Everything here takes and returns DataFrames or Columns.  See the README for
the map from task to module.
"""
