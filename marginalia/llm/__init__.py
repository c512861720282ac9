"""Training-data operators: deduplication, scoring, filtering, redaction, mixing.

Nothing outside this subpackage imports it.
"""
