"""Operators of a training-data pipeline (packing, search, dedup, filters).

Nothing else in the library imports this subpackage; ``queries`` registers
its ``opN_`` queries and the pipeline.
"""
