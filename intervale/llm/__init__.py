"""Training-data operators over documents, pages and benchmark items.

Nothing else in the library imports this package.
"""
