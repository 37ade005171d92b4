"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this package imports it; ``queries.REGISTRY`` lists its
driver queries.
"""
