"""Training-data operators: ten self-contained Spark jobs over documents, embeddings and conversations.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
queries registered by ``__spark_entry__.py``.
"""
