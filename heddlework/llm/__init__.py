"""Operators of a training-data pipeline: filters, joins, models, sampling, formats."""
