"""Storage-inventory analytics as Spark DataFrame operators.

A *snapshot* is one listing of a file tree or object store, kept as one
partition of a Parquet table.  Every operator takes DataFrames and returns a
DataFrame; nothing here runs an action unless its docstring says so.
"""
