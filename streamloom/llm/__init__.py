"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface; ``queries.py`` holds the thin ``opN_<name>`` queries and
``oracles.py`` their SQL.
"""
