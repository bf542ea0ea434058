"""Training-data operators: quality, packing, search, extraction, scoring, mixing, joins, secrets, counts, languages."""
