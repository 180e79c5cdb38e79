"""Operators of a training-data pipeline: scans, joins, models and tokenizers over documents and pages."""
