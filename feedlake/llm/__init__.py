"""Training-data operators: ten dealt methods and the corpus pipeline built from them.

Nothing else in the library imports this package.
"""
