"""Training-data operators: extraction, deduplication, filtering, packing and formatting of text corpora.

Nothing outside this folder imports it; `queries.py` lists its registered queries.
"""
