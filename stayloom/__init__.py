"""stayloom: cohort analytics on Spark DataFrames.

Operators take and return DataFrames; nothing in the package runs a job unless its docstring says so.
"""
