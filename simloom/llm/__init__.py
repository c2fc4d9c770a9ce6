"""Training-data operators: ten operators over documents, pages and conversations.

Nothing else in the library imports this subpackage.
"""
