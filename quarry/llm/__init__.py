"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
