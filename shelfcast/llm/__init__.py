"""Training-data operators: mixing, token counts, secret scans, decontamination,
quality rules, line dedup, license scans, near-duplicates, byte dedup, PII,
cross-tokenizer alignment, hard negatives, URL filter.

Each module holds one operator; :mod:`shelfcast.llm.queries` registers them.
Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
