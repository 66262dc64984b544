"""Prepare, check and score training pairs for text extraction on Spark.

Every operator takes and returns DataFrames (or Columns), so that plans compose
and Catalyst sees the whole job.
"""
