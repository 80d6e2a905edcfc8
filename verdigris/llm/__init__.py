"""Training-data operators: language ID, tokenising, media, licences, mixing,
near-dedup, exact search, quality, token files and page text.

Nothing outside this subpackage imports it.
"""
