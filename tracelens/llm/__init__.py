"""Operators that prepare documents for language-model training.

Each module holds one operator with its own general interface; the registered
queries over the driver tables are in ``queries``.  Nothing outside this
subpackage imports it.
"""
