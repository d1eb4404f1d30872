"""Operators of a training-data pipeline: filters, joins, scans, packing and storage of token ids."""
