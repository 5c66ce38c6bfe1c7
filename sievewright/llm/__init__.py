"""Training-data operators: packing, decontamination, PII, near-dedup, fingerprints, language ID and so on.

Nothing outside this subpackage imports it.
"""
