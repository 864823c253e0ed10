"""Training-data operators (language ID, token counts, near-dedup, mixing, token output,
packing, fingerprints, LM scoring, nearest neighbours, sharding).

Nothing outside this subpackage imports it; the queries are in :mod:`.queries`.
"""
