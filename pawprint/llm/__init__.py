"""Training-data operators: each module is one operator over a DataFrame of documents.

Nothing outside this subpackage imports it.
"""
