"""Training-data operators: quality, tokens, pages, packing, near duplicates, media, language, lines, BPE, shards.

Nothing outside this subpackage (and the guarded import in ``__spark_entry__``) depends on it.
"""
