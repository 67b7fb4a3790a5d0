"""Operators of a training-data pipeline: filters, deduplication, extraction, tokens and archives.

Nothing outside this folder imports it. Each module holds one operator with its own general
interface; ``queries`` holds the registered queries, which call the operators with production
parameters and derive the columns of their results.
"""
