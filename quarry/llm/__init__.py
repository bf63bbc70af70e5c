"""Training-data operators: packing, token counts, vector search, PII, toxicity, language
ID, BPE, language-model scoring and near-duplicate joins.

Nothing else in the library imports this package; ``__spark_entry__`` adds its queries
when it can be imported.
"""
