"""Operators for the text of large language models' training data. Nothing outside this package imports it."""
