"""Operators for training-data text: one module per problem.

Nothing outside this subpackage imports it.
"""
