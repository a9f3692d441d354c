"""Training-data operators: deduplication, scoring, tokenising, packing.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
