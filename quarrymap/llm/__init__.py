"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this subpackage imports it; it imports nothing from the rest
of the library, so either side can be removed without the other noticing.
"""
