"""Training-data operators: dedup, joins, tokenizing, search, packing, scoring.

Nothing outside this subpackage imports it. ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains four of them.
"""
