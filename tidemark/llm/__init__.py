"""Operators of a training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries`` in :mod:`tidemark.llm.registry` is what the
driver's entry module adds when the subpackage is there.
"""
