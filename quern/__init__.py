"""Relational analytics with MySQL result semantics, written as Spark Columns, DataFrames and SQL."""
