"""Operators for training-data pipelines. Nothing outside this folder imports them; delete it and the rest still works."""
