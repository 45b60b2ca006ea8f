"""Column-level helpers; everything here is a built-in Spark expression."""
