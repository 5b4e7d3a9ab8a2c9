"""Relational-graph analytics on Spark: tables as a typed, time-stamped graph, queried with DataFrames."""
