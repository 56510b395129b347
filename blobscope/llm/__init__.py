"""Operators for preparing training data: deduplication, decontamination, PII, tokens, shards.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
