"""Operators for pipelines of training data; nothing outside this folder imports them."""
