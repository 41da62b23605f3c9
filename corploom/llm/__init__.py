"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  One module holds one
operator together with its thin ``opN_<name>`` query; ``registry`` lists the
queries and their SQL.
"""
