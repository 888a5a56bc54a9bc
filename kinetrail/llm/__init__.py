"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; the registry module at
the repository top adds its queries only when it can be imported.
"""
