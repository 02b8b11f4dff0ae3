"""Training-data operators: filtering, mixing, deduplication, tokens, archives.

Nothing else in the library imports this subpackage.
"""
