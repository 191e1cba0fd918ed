"""Training-data operators: ten text, url, vector and page operators for corpora.

Nothing else in the library imports this subpackage.
"""
