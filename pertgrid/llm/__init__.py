"""Training-data operators: deduplication, filtering, mixing, formatting and token output.

Nothing else in the library imports this subpackage.  Each module holds one operator; ``queries`` binds
them to the tables of a data folder.
"""
