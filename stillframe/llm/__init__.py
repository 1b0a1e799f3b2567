"""Training-data operators: ten first-class components on documents, conversations and embeddings.

Nothing outside this subpackage (and `corpus_pipeline.py`) imports it; deleting the folder leaves the snapshot
engine whole.
"""
