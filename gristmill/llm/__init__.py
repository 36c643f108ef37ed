"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` holds the registry that
``__spark_entry__`` adds when the subpackage is present.
"""
