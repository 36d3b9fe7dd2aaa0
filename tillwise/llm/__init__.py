"""Operators that prepare a training corpus: ``documents``, ``benchmark`` and ``embeddings`` in, decisions out."""
