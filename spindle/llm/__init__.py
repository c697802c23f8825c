"""Training-data operators: media columns, deduplication, scoring, tokens, packing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present.
"""
