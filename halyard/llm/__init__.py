"""Operators for training-data pipelines: ten document-scale operators that nothing else in the package imports."""
