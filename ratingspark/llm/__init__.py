"""Operators of a training-data pipeline: filters, de-duplication, mixing, sharding, scoring and tokenising.

Each module holds one operator; ``queries`` applies them to the driver's tables.
"""
