"""Training-data operators: dedup, media, secrets, PII, language, toxicity, tokens, packing, quality.

Nothing else in the library imports this subpackage.
"""
