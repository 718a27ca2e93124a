"""Column functions: all built-in expressions, none a UDF."""
