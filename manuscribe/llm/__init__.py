"""Training-data operators: near-duplicates, packing, archives, scoring, scans."""
