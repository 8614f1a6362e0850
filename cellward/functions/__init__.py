"""Column functions: text in, Column out. No Python UDF."""
