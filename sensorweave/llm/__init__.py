"""Training-data operators: sharding, dedup, cleaning, packing, tokenisation and fingerprints.

Nothing outside this subpackage imports it.
"""
