"""Operators of a training-data pipeline: extraction, de-duplication, filtering, tokens.

Nothing else in the package imports this folder.
"""
