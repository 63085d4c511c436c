"""Training-data operators: packing, decontamination, chat trees, secrets, dedup, quality, WARC, token files.

Nothing outside this subpackage imports it.
"""
