"""Operators on DataFrames: ingest, sampling, tasks, encoders, few-shot, aggregation, metrics, merge, model."""
