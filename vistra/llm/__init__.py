"""Operations for training-data pipelines: ten operators over documents, pages and embeddings.

Nothing else in the package imports this subpackage.
"""
