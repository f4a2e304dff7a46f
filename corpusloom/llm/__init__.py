"""Training-data operators: one module each, queries in ``queries.py``.

Nothing outside this folder imports it; it can be deleted without touching the
rest of the library.
"""
