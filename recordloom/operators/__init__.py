"""Table-to-table operators. Each takes DataFrames and column names and returns a DataFrame."""
