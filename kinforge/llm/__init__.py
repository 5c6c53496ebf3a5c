"""Training-data operators: packing, mixing, near-duplicates, archives, token counts, models and scans.

Nothing outside this subpackage imports it; ``queries`` holds its registered queries and SQL.
"""
