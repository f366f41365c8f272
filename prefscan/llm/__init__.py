"""Operators of a training-data pipeline (see the README's section on them).

Nothing else in the library imports this subpackage.
"""
