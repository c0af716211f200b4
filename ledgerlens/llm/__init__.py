"""Operators for large-scale training-data preparation.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator.  Nothing outside this subpackage imports it, apart
from the guarded registration in ``__spark_entry__.py``.
"""
