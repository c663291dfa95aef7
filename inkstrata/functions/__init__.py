"""Column expressions, and functions over parsed trees."""
