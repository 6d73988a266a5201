"""Operators of a training-data pipeline: tables in, tables out."""
