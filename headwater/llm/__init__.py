"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries and their SQL for the driver entry file.
"""
