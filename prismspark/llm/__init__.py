"""Training-data operations for corpora of documents and embeddings.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
