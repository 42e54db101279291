"""Spark-native analytics for monthly production time series.

Every operator takes and returns DataFrames.  Reading and writing happen only in
``prodlake.sources`` and ``prodlake.plans``.
"""
