"""Training-data operators: quality, toxicity, dedup, mixing, packing, media, HTML, nearest neighbours.

Nothing outside this subpackage imports it, so the folder can be removed as a whole.
"""
