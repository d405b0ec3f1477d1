"""Operators for large-scale training-text pipelines. Nothing outside this sub-package imports it."""
