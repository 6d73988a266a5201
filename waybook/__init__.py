"""Trajectory analytics on Spark: columns in, columns out; tables in, tables out."""
