"""Training-data operators over document, page and label tables.

Every operator is a function of DataFrames; the thin ``opN_`` queries in
``queries.py`` derive their digest columns from what the operators return.
"""
