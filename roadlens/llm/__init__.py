"""Training-data operators over documents, vectors and web pages.

Nothing outside this package imports it; the queries are in ``queries``.
"""
