"""Training-data operators: quality, mixing, tokens, duplicates, packing, pages, media, licences.

Nothing outside this subpackage imports it.
"""
