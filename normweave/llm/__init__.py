"""Training-data operators: cleaning, scoring, deduplication, audit, mixing, coding, search.

Nothing outside this subpackage imports it.
"""
