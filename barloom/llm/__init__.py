"""Training-data operators.  Nothing outside this subpackage imports it.

Each module holds one operator with a general interface; ``catalog`` holds the thin
``opN_<name>`` queries that derive the digest columns of their contracts.
"""
