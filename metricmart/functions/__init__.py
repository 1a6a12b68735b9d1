"""Column-returning functions: no UDFs."""
