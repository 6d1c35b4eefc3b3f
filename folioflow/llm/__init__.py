"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` in
:mod:`folioflow.llm.catalog` are what the entry module registers.
"""
