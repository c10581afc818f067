"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface and the thin ``query`` that applies it to its whole table.
"""
