"""Operators for preparing large text collections for language-model training.

Nothing outside this subpackage imports it; removing the folder leaves the rest
of the library working.
"""
