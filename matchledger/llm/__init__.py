"""Training-data operators: scoring, packing, filtering, search, tokens, deduplication and media.

Nothing else in the package imports this folder; ``registry`` lists its queries.
"""
