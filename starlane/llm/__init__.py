"""Operators for preparing text training data: filters, joins, models, codecs."""
