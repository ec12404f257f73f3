"""Column expressions: every function takes columns and returns a column, and runs inside Spark's generated code."""
