"""Training-data operators: language ID, dedup, decontamination, tokens, media, shards, URLs, PII.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
