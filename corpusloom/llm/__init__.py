"""Training-data operators: filters, scans, joins, tokenising and mixing over document tables."""
