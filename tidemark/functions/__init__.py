"""Column-valued scalar functions."""
