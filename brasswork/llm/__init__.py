"""Training-data operators (packing, mixing, classification, joins, fingerprints, formatting, search)."""
