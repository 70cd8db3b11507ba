"""Operators for preparing training corpora: packing, filtering, deduplication, archives and scoring.

Nothing else in the library imports this subpackage; ``llm.registry`` lists its queries.
"""
