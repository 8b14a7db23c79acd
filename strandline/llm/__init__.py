"""Training-data operators: dedup, quality, mixing, tokens, archives, safety.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered
queries, ``sql.py`` their SQL; every other module is one operator.
"""
