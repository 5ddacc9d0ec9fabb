"""Column functions: every formula is a built-in expression, none is a UDF."""
