"""Operators of a training-data pipeline: archives, scans, joins, models and packing."""
