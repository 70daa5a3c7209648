"""Operators of a training-data pipeline.

Each module holds one operator with a general interface (any id and text
column, any parameters); ``queries`` applies them to the given tables.
Nothing outside this folder imports it.
"""
