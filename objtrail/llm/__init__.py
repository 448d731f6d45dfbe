"""Training-data operators: dedup, packing, scoring, extraction, tokenising.

Nothing outside this subpackage imports it.  Each operator module exposes a
general function over DataFrames; ``queries.py`` holds the thin registered
queries and ``oracles.py`` their SQL where SQL can express them.
"""
