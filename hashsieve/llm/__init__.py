"""Training-data operators: dedup, search, archives, mixing, tokens, language, extraction, quality, chat.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
