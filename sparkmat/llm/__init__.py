"""Training-data operators: language id, PII, packing, dedup, token counts, sampling, search, WARC and quality rules.

Nothing outside this subpackage imports it.
"""
