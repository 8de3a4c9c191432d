"""Training-data operators: search, mixing, packing, joins, filters and formatting."""
