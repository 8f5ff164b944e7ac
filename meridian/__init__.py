"""A PySpark engine for gridded, point and feature data: sources, cadence, selection, cache and sinks as DataFrames."""
