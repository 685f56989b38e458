"""Training-data operators: near-duplicates, PII, line dedup, token files,
URL filters, fingerprints, packing, language ID, embeddings, BPE.

Nothing else in the library imports this package.
"""
