"""Retail and census analytics as Spark DataFrame plans.

Layout:
  sources/    the nine input relations over the raw parquet tables
  functions/  column expressions (scalar semantics, distances)
  operators/  distributed building blocks (row numbering, NTILE, exact
              percentiles, mode per key, distance join, sampling, joins)
  plans/      one function per analytics statement, grouped by theme;
              ``plans.registry`` maps query keys to functions + parameters
  oracle/     independent DuckDB texts of the same queries (tests only)
"""
