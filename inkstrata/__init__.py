"""Document analytics on Spark: sources, functions, operators, plans and streaming over relational blocks and spans."""
