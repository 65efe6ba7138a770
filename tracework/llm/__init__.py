"""Training-data operators: ten corpus-scale steps and their queries.

Nothing else in the package imports this subpackage.
"""
