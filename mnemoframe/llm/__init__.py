"""Training-data operators: extraction, filtering, deduplication, encoding, packing.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; :mod:`mnemoframe.llm.queries` holds the thin queries.
"""
