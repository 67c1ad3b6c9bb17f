"""Operators of a training-data pipeline: each module holds one operator and its `opN_` query.

`QUERIES` and `ORACLES` are what the repository's entry module registers. Nothing outside
this subpackage imports it, so it can be deleted without touching the rest of the library.
"""
