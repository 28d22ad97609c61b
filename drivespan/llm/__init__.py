"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this folder imports it; it may be deleted whole.
"""
